"""Operators for large text corpora. Nothing outside this folder and ``corpus_pipeline.py`` uses them."""
