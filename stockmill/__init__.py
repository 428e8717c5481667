"""Inventory analytics on Spark: feeds, quality gates, monthly marts, action rules."""
