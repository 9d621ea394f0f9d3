"""Training-data operators: mixing, language id, sharding, extraction, quality, decontamination, near and exact
duplicate removal, WARC output. Nothing outside this package imports it."""
