"""Operators on labelled and scored tables."""
