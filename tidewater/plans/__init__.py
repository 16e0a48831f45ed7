"""Batch pipelines built from the operators, and the views over their output."""
