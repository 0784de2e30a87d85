"""Readers and writers: workbooks, all-text bronze, keyed tables, evaluation sets."""
