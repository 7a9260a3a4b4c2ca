"""DataFrame operators: ordered series, fits, joins, corpus and log operators."""
