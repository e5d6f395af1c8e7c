"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``millrace.llm.queries`` lists its
queries for the driver's entry module.
"""
