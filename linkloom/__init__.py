"""Entity resolution of business records on Spark."""
