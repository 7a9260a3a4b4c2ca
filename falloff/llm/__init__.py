"""Operators for preparing training corpora: search, dedup, sampling, privacy, language, sharding, extraction."""
