"""Listing analytics on Spark: faceted search, reports, cleaning, extraction and incremental state as DataFrame functions."""
