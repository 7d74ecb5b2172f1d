"""Training-data operators: ten independent Spark jobs over a document corpus."""
