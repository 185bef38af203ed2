"""Operators for preparing training text. Nothing else in the library imports this subpackage.

All of them take whole texts of any length, give an empty result for an empty table, and ignore columns they don't name.
"""
