"""Survey data quality on Spark: codebooks, rules and expressions compiled to Catalyst columns."""
