"""pricelens: retail-offer analytics on Spark.

Every public operator takes and returns DataFrames. Library code never creates a
SparkSession, never collects, and never uses an unpartitioned window.
"""

__version__ = "0.1.0"
