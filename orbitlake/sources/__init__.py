"""Readers that turn receiver files into long tables."""
