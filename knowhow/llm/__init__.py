"""Operators that prepare a corpus for training language models."""
