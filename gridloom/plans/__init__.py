"""Whole runs: clustering, its step-by-step form over cells, and the summary of a run."""
