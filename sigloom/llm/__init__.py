"""Training-data operators: filtering, deduplication, tokenisation, packing and archive output."""
