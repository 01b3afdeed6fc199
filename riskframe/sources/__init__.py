"""Readers, writers, stored models and generated tables."""
