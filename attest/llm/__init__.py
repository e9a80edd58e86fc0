"""Operators for preparing language-model training data, each whole-table and skew-safe."""
