"""Graphs made of the relational tables, and the registered queries with their SQL."""
