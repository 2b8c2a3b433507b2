"""Column functions: sequences, qualities, cigars, motifs and abundance thresholds."""
