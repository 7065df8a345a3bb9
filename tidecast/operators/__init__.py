"""Lazy DataFrame operators over the long table (series_id, ts, y)."""
