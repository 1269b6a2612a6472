"""Relational and matrix operators on answer sets."""
