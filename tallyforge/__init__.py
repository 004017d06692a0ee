"""Census analytics on Spark: text signals, joins, rankings, metrics and graphs over DataFrames."""
