"""Column expressions and aggregates that Spark does not ship."""
