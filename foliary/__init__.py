"""Document archives as queryable, dated events: DataFrame operators on Spark."""
