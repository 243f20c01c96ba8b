"""Foliant: document analytics on PySpark."""
