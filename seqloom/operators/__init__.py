"""Relational operators on token sequences, texts and model tables."""
