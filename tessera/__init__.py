"""Product analytics and document processing as Spark DataFrames."""
