"""plinth: a fluent, immutable query and data-processing engine on PySpark DataFrames."""
