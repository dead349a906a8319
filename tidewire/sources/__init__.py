"""Readers of landed files, small dimension tables, and writers."""
