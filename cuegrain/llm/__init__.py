"""Training-data operators: near-duplicate joins, line and substring dedup, scans, tokenising, mixing, search."""
