"""Retrieval and routing plans."""
