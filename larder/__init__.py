"""Larder: analytics over replicated, content-addressed object stores, on PySpark."""
