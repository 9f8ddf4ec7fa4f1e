"""Readers and writers: edge files, result files, tables."""
