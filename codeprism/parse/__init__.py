"""Parsers: source text to rows. Pure Python per file, run as Arrow maps over the files table."""
