"""Quality analysis and training-data preparation for page-traceable document corpora on PySpark."""
