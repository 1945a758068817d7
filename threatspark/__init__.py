"""Network-threat analytics on Spark tables and streams."""
