"""Scoring requests as a batch or a stream."""
