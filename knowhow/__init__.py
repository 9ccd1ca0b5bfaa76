"""Expertise discovery over organisational documents, as Spark DataFrame operators."""
