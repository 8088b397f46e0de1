"""Relational shapes, linear algebra, iterative fits, triage notes and fingerprints."""
