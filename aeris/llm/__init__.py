"""Training-data operators (dedup, search, sharding, packing, filters, scans)."""
