"""Sources and sinks beyond Spark's built-in ones."""
