"""Composed stages with their defaults."""
