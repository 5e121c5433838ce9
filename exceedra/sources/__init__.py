"""Sources of the exceedance engine."""
