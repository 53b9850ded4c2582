"""Operators for large text corpora: sharding, fingerprints, packing, near-duplicates and filters."""
