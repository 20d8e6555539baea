"""Relational operators on records, candidates and scores."""
