"""Training-data operators: language ID, token counts, licence scans, near duplicates, sharding, packing,
decontamination and line / substring dedup.  Nothing outside this subpackage imports it."""
