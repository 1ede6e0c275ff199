"""Registered queries over the star-schema tables, each with the same question in SQL."""
