"""Training-data operators: fingerprints, sharding, decontamination, scans, tokenization, archives."""
