"""Fund-trail analytics as Spark DataFrames."""
