"""Irregular long-format event tables -> analysis-ready cohorts and evaluated models, on Spark."""
