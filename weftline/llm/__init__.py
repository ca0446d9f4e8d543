"""Operators for building training corpora: deduplication, filtering, labelling, packing and placement."""
