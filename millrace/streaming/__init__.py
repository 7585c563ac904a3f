"""Structured Streaming: typed sources, row-wise transforms, tiles, backfill, ingest."""
