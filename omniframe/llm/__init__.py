"""Training-data operators: extraction, scoring, deduplication, filtering, mixing, encoding."""
