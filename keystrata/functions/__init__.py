"""Column functions on fixed-length records."""
