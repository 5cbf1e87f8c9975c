"""Document analytics on Spark: structure, context and profile operators over DataFrames."""
