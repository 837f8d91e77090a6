"""Operators for building training corpora at scale. Nothing else in riverbend imports this."""
