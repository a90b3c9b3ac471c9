"""Operators for preparing training corpora: dedup, sharding, token files, media, scoring, packing."""
