"""Micro-batch registration of documents."""
