"""Text-corpus operators: scoring, deduplication, tokenising, search and extraction."""
