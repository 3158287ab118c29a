"""The enrichment export over a stream of booking files."""
