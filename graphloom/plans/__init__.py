"""Whole jobs: the hierarchy build, its command line, and the registered queries."""
