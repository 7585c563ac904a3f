"""Relational operators: as-of joins, tiled features, rollups, preprocessing, metrics."""
