"""Readers and the results catalog."""
