"""Operators over collections, vectors and faces."""
