"""Readers of conversation exports and captures."""
