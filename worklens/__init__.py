"""Work-item analytics on Spark: DataFrame -> DataFrame functions, no engine internals."""
