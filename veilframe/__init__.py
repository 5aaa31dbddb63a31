"""veilframe: reversible pseudonymisation and analysis of database diagnostic text on Spark DataFrames."""
