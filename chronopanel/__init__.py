"""chronopanel: causal time-series features, labels and walk-forward evaluation on Spark.

Every operator takes and returns Spark DataFrames.  The canonical input is a
long panel ``(series_id, date, open, high, low, close, adj_close, volume)``
with one row per series and period.
"""
