"""Scans of methylation, variant and region files, and views over the supplied star schema."""
