"""dagspark: analysis pipelines as DAG documents, compiled to Spark DataFrames."""
