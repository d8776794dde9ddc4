"""A Spark-native engine for collections of 3-D polylines (tractograms)."""

__version__ = "0.1.0"
