"""Operators for training-data pipelines: deduplication, search, classifiers, tokenisers and mixing."""
