"""Operators over reads: alignment, classification, extension, correction, annotation."""
