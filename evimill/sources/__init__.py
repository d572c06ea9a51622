"""Readers and writers, and the views the queries build on the given tables."""
