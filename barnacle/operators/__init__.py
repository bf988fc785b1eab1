"""Matching and counting."""
