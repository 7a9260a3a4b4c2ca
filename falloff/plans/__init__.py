"""Composed queries: interpretation of whole corpora and the registered query catalogue."""
