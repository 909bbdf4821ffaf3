"""Joins and per-order / per-seller aggregations shared by the models."""
