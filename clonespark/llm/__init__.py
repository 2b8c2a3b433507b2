"""Training-data operators: text columns, corpora and vectors.

Nothing outside this subpackage imports it.  Each operator has a module of its
own; ``queries`` binds them to the tables they are meant for.
"""
