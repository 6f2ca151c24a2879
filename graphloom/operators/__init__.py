"""Relational building blocks and graph algorithms over edge tables."""
