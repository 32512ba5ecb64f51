"""Operators that prepare text corpora for training language models; nothing outside imports this package."""
