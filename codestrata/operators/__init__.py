"""Analyses: DataFrame to DataFrame, lazy."""
