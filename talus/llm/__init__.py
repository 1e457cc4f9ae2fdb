"""Operators for preparing training data from text: one module per operator, queries in ``queries``."""
