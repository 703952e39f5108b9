"""Operators from one DataFrame to another."""
