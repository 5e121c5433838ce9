"""Plans of the exceedance engine."""
