"""Queries that apply the operators to tables, and their SQL."""
