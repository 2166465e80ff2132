"""millrace: dataflow pipelines and large-scale data processing on Spark DataFrames."""
