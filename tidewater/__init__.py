"""Environmental-monitoring analytics written as Spark DataFrame plans."""
