"""skein: logs, metrics and traces as plain Spark DataFrame plans."""
