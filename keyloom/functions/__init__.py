"""Subpackage of keyloom."""
