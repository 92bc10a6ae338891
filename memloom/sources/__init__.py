"""memloom sources."""
