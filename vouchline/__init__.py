"""vouchline: document-verification analytics as composable Spark DataFrames."""
