"""memloom streaming."""
