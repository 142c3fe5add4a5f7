"""Sampling, split points, range partitioning, sorting, cataloguing and checking of records."""
