"""Operators for training-data pipelines.

Nothing outside this folder imports it.  ``queries`` holds what the entry module registers.
"""
