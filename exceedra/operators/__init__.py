"""Operators of the exceedance engine."""
