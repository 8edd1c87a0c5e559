"""Array analytics and coupling on Spark: named dimensions, typed variables, box selection, matching and exchange."""
