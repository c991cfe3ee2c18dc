"""Operators for training data: vectors, clusters, name mapping, samples, packing, mixing and personal data.

Nothing outside this subpackage imports it.
"""
