"""hourglass: Spark-native demand forecasting and multi-touch attribution.

Every public operator takes and returns Spark DataFrames. Nothing is
collected to the driver; heavy work runs as Spark SQL expressions, joins,
windows, aggregates, MLlib, or grouped pandas functions.
"""

__version__ = "0.1.0"
