"""Spark jobs for airborne methane surveys and for large text corpora."""
