"""Aeris: Spark-native sensor time-series analytics.

Every operator is a ``DataFrame -> DataFrame`` function built from native column
expressions, distributed ordered primitives and Spark ML.
"""

__version__ = "0.1.0"
