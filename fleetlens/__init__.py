"""fleetlens: diagnostics analytics for fleets of streaming-broker clusters, on Spark.

Every table carries ``bundle_id`` (one diagnostic bundle of one cluster), so a job over
a fleet is the same job as over one bundle, only with more partitions.
"""

__version__ = "0.1.0"
