"""Streaming of the exceedance engine."""
