"""DataFrame operators: joins, aggregations, windows, detection rules, scoring and verdict tables."""
