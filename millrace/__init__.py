"""millrace: validated batch pipelines and data-processing operators on Spark DataFrames."""
