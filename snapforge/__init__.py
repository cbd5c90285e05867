"""Versioned reference tables on Spark."""
