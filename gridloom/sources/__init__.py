"""Readers and writers of points and labels."""
