"""Training-data operators: media, tokenising, filtering, deduplication, packing. Nothing outside this folder imports it."""
