"""Training-data operators: near-dedup, scans, decontamination, sharding, filters, encoders."""
