"""Evidence analytics on Spark: corpus scans, tool logs, inventories, reports."""
