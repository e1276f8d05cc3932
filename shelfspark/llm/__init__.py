"""Operators for preparing text corpora for the training of language models."""
