"""Extraction, resolution and quality operators."""
