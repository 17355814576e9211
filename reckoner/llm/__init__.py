"""Operators that prepare training data: consensus labels, quota samples, leakage, mixtures, residue.

Nothing outside this subpackage imports it.
"""
