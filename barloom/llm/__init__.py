"""Operators that prepare text corpora for training: dedup, scans, tokenising, scoring, packing."""
