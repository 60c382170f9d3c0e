"""Sources, sinks and preparation of rated texts."""
