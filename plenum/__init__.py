"""Civic analytics on Spark."""
