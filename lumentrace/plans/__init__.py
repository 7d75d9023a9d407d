"""Reusable plan shapes: skew-safe joins, distributed ranking, exact rank picks."""
