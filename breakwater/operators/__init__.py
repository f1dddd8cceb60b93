"""Transforms, running sums, estimators and segment statistics as plain DataFrame code."""
