"""Readers, loaders and the derived document corpus."""
