"""Whole jobs and named questions, composed from the operators."""
