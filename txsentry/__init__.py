"""txsentry — transaction-risk analytics on Spark.

Subpackages: ``sources`` (tables, files), ``functions`` (column
expressions), ``operators`` (DataFrame operators), ``plans`` (jobs and the
registered queries), ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
