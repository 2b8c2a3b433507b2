"""Rows that every operator on texts must bear."""

ODD = [(None, None), (None, "no id"), (5, None), (6, ""), (7, " \n\t "), (8, "é日本😀\n" * 3), (9, "same"), (9, "same"), (9, "other"), (10, "a"), (11, "x" * 300_000), (12, "word " * 60_000)]
