"""Readers, writers, dimensions and fixed values."""
