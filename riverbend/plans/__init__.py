"""Flows: configuration, validation and batch runs."""
