"""From a query string to a Spark plan."""
