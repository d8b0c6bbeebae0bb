"""Operators on points, cells, pairs and graphs."""
