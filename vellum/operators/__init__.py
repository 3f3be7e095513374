"""Operators over notes, documents and vectors."""
