"""Taxonomies with members as Spark tables: expansion, membership threads, repair, and their measurement."""
