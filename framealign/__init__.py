"""framealign: planetary image correspondence at catalog scale, as Spark DataFrames."""
