"""Halyard: a Spark-first engine for physiological time series and evaluated clinical text."""
