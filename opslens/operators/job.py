"""Family I — Agent jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tsql import ci_like_any
from ..plans.patterns import like_any_of
from ..plans.shape import kcols

# Name fragments that mark a maintenance job.
MAINTENANCE_PATTERNS = ["%full%", "%bkp%", "%dba%", "%backup%", "%diff%", "%log%", "%bkup%"]


def maintenance_job_steps(jobs: DataFrame, steps: DataFrame, patterns=None, keys=None) -> DataFrame:
    """Steps of jobs whose name looks like a maintenance job, with retry
    attempts and interval. Jobs are filtered before the join. ``patterns``: a
    list, or a table of any size with a ``pattern`` column."""
    k = kcols(keys)
    if isinstance(patterns, DataFrame):
        chosen = like_any_of(jobs, "name", patterns)
    else:
        chosen = jobs.filter(ci_like_any("name", patterns or MAINTENANCE_PATTERNS))
    j = chosen.select(*k, "job_id", F.col("name").alias("job_name"), "enabled")
    s = steps.select(*k, "job_id", "step_name", "step_id", "retry_attempts", "retry_interval")
    return j.join(s, k + ["job_id"], "inner").drop("job_id")
