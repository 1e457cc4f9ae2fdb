"""Role tables over the driver's parquet, the registered queries and their SQL twins."""
