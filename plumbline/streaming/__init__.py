"""Scoring of answer sets as they arrive."""
