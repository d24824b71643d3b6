"""Queries over the driver's tables: each pairs a Spark plan with SQL for an independent check."""
