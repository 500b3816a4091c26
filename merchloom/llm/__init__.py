"""Training-data operators: scoring, filtering, deduplication, extraction, mixing and privacy."""
