"""Corpus operators for training-data pipelines; nothing else in quillon imports this package."""
