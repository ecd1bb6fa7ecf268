"""Renderers and writers of results."""
