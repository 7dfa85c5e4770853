"""Market-signal analytics on Spark: DataFrame functions over bars, series, graphs and predictions."""
