"""Operators over collections; each module holds one family."""
