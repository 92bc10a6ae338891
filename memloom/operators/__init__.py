"""memloom operators."""
