"""mathloom: batch search and data processing over school-maths questions on Spark DataFrames."""

__version__ = "0.1.0"
