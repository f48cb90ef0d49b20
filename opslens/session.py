"""Session settings for running opslens on a large cluster.

Library functions never change session configuration; this helper is for
the job that owns the session. Numbers are starting points for a fleet
landing of ~100 TB on ~1000 executors.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def cluster_conf(executors: int, cores_per_executor: int) -> dict[str, str]:
    slots = executors * cores_per_executor
    return {
        # Adaptive execution: right-size shuffle partitions from real map
        # output, split skewed join partitions, demote/promote joins by
        # measured size.
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        # Initial shuffle width: ~3 waves of tasks; AQE coalesces downward.
        "spark.sql.shuffle.partitions": str(slots * 3),
        # Scan splits that fit comfortably in executor memory.
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        # Static broadcast only for genuinely small relations; AQE may still
        # broadcast at run time from measured sizes.
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
        "spark.sql.parquet.filterPushdown": "true",
        # Survive executor loss: shuffle files served outside executors.
        "spark.shuffle.service.enabled": "true",
        "spark.decommission.enabled": "true",
        "spark.storage.decommission.shuffleBlocks.enabled": "true",
    }


def apply(builder: SparkSession.Builder, executors: int, cores_per_executor: int) -> SparkSession.Builder:
    for k, v in cluster_conf(executors, cores_per_executor).items():
        builder = builder.config(k, v)
    return builder
