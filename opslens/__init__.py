"""opslens — database-fleet telemetry analytics on Spark.

Catalog views, DMVs, backup history, wait statistics, session snapshots,
event files, plans and permission tables collected from many servers are
read as DataFrames keyed by (server_name, snapshot_id); every operator is a
DataFrame -> DataFrame function over them (see ``opslens.operators``).
"""

from .plans.shape import SNAP  # noqa: F401

__all__ = ["SNAP"]
