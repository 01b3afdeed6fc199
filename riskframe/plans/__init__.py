"""Whole jobs: training, and the registered queries."""
