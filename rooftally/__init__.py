"""Analytics for large inventories of detected footprints, written for Spark."""
