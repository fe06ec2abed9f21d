"""Reading and writing: partitioned scans, inventories, caches, compaction, append."""
