"""Queries over the driver tables, with SQL to hold them against."""
