"""Session-event analytics on Spark."""
