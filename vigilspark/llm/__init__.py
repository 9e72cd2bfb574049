"""Operators for preparing language-model training data. No other part of the library imports this package."""
