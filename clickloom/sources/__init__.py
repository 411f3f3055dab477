"""Readers and writers of clickstream tables."""
