"""Document analytics on Spark: scans, retrieval, checks, rollups and corpus tools."""
