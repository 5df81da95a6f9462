"""Corpus ingest and cleaning on Spark: pages and chapters in, clean books, issues and reports out."""
