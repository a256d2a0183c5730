"""Spark-first engine for finding, scoring and masking personal data at corpus scale."""
