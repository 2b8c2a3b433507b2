"""Reading sequencing files and reference tables, and writing results."""
