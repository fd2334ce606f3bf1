"""Operators for preparing training data: one module for each, `queries` for their registered queries."""
