"""Training-data operators: packing, deduplication, filtering and scanning of text corpora."""
