"""Whole-analysis plans built from the operators."""
