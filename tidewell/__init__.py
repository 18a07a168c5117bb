"""Spark-first curation of instruction data for language models."""
