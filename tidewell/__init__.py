"""tidewell: text ETL, retrieval, evaluation and training-data preparation as Spark plans."""
