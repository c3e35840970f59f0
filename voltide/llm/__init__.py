"""Training-data operators: deduplication, mixing, scoring, scanning and tokenising of document tables."""
