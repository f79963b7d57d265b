"""Operators for building language-model training data (each module names its method)."""
