"""Operators for preparing training data: extraction, language, quality, toxicity, copies, leaks and tokens."""
