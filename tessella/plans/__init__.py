"""Helpers that shape plans: cutting lineage, sizing partitions."""
