"""Period analytics on PySpark: scans, resampling, period measures, association tests, models, streams."""
