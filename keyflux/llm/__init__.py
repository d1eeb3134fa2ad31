"""Training-data operators: dedup, formatting, mixing, scoring, search, archives and packing."""
