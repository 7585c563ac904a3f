"""Scalar helpers: intervals, time slices, identifiers, guarded arithmetic."""
