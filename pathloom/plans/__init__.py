"""Patterns and how they become joins."""
