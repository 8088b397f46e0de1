"""Strategies, their explanations, and the catalogue of queries."""
