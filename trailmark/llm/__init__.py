"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
