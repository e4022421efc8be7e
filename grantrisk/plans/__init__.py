"""Pipelines (ETL, report, training) and the registered query set."""
