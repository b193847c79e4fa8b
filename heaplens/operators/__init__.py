"""Operators from lines to metric samples."""
