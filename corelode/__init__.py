"""Drill-hole assay analytics as Spark jobs."""
