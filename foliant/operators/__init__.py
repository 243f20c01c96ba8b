"""Operators over documents, chapters, tables of contents, sections and figures."""
