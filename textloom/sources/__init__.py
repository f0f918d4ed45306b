"""Readers of corpora, annotations, category tables and models, and writers of results."""
