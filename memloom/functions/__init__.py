"""memloom functions."""
