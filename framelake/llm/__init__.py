"""Operators for training-data corpora: packing, deduplication, archives, filters, tokens, classifiers, fingerprints.
Nothing outside this package imports it."""
