"""Registered queries over the driver tables."""
