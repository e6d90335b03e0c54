"""Spark jobs for an e-commerce warehouse: logs, change events, wide facts, statistics, reports."""
