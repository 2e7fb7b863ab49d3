"""Sources, sinks and places."""
