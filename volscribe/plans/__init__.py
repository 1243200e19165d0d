"""Inputs, pipelines and the query registry."""
