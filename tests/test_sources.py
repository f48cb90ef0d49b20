"""Sources and sinks (R1-R7): declared-schema reads, fleet key defaults,
per-database accumulation, partitioned result writes."""

import os

from pyspark.sql import functions as F

from opslens.operators import storage as C
from opslens.sources import loader as L

from .conftest import SF_SMALL


def test_load_snapshot_formats_and_defaults(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "database_id int, name string")
    for fmt in ("parquet", "json", "csv"):
        path = os.path.join(tmpdir_path, fmt)
        w = df.write.mode("overwrite").format(fmt)
        (w.option("header", "true") if fmt == "csv" else w).save(path)
        back = L.load_snapshot(spark, path, schema="database_id int, name string", fmt=fmt,
                               server_name="srvA", snapshot_id=7)
        rows = sorted((r.server_name, r.snapshot_id, r.database_id, r.name) for r in back.collect())
        assert rows == [("srvA", 7, 1, "a"), ("srvA", 7, 2, "b")]


def test_union_landed_accumulates_per_database(spark):
    a = spark.createDataFrame([("srv", 0, "db1", 5)], "server_name string, snapshot_id int, database_name string, n int")
    b = spark.createDataFrame([("srv", 0, "db2", 6)], "server_name string, snapshot_id int, database_name string, n int")
    assert L.union_landed([a, b]).count() == 2


def test_write_result_partitions_by_date(spark, tmpdir_path):
    df = spark.createDataFrame([("srv", 0, "2024-01-02 10:00:00", "C9", "ok", "0", "fine")],
                               "server_name string, snapshot_id int, snapshot_ts string, check_id string, "
                               "severity string, observed string, message string") \
        .withColumn("snapshot_ts", F.col("snapshot_ts").cast("timestamp"))
    out = os.path.join(tmpdir_path, "findings")
    L.write_result(df, out)
    assert any(d.startswith("snapshot_date=2024-01-02") for d in os.listdir(out))
    assert spark.read.parquet(out).count() == 1


def test_write_result_is_idempotent_per_date_and_server(spark, tmpdir_path):
    def rows(servers, message):
        return spark.createDataFrame([(s, 0, "C9", message) for s in servers], "server_name string, snapshot_id int, check_id string, message string") \
            .withColumn("snapshot_ts", F.lit("2024-01-02 10:00:00").cast("timestamp"))
    out = os.path.join(tmpdir_path, "findings")
    L.write_result(rows(["a", "b"], "one"), out)
    L.write_result(rows(["a"], "two"), out)
    L.write_result(rows(["a"], "two"), out)
    assert sorted((r.server_name, r.message) for r in spark.read.parquet(out).collect()) == [("a", "two"), ("b", "one")]


def test_declared_schemas_cover_every_relation(spark):
    from opslens.sources.bindings import BINDINGS, relation
    from opslens.sources.schemas import SCHEMAS
    assert set(SCHEMAS) == set(BINDINGS)
    for name, schema in SCHEMAS.items():
        got = [(f.name, f.dataType) for f in relation(spark, SF_SMALL, name).schema]
        assert got == [(f.name, f.dataType) for f in spark.createDataFrame([], schema).schema], name


def test_load_fleet_reads_with_declared_types(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "land")
    spark.createDataFrame([("s", "1", "7", "x")], "server_name string, snapshot_id string, sid string, name string") \
        .write.json(os.path.join(root, "logins"))
    spark.createDataFrame([("s", 1, 7, "x")], "server_name string, snapshot_id int, sid long, name string").write.json(os.path.join(root, "packages"))
    got = L.load_fleet(spark, root, ["packages"], fmt="json")["packages"]
    assert dict(got.dtypes) == {"server_name": "string", "snapshot_id": "int", "name": "string", "owner_name": "string"}


def test_operator_on_landed_snapshot(spark, tmpdir_path):
    files = spark.createDataFrame(
        [(2, "tempdb", 0, 1024, 128), (2, "tempdb", 0, 1024, 128), (2, "tempdb", 1, 512, 64)],
        "database_id int, database_name string, type int, size long, growth int")
    path = os.path.join(tmpdir_path, "master_files")
    files.write.parquet(path)
    landed = L.load_snapshot(spark, path, server_name="srvA")
    f = C.tempdb_file_count(landed).collect()[0]
    assert f.server_name == "srvA" and f.observed == "2"
    u = {r.check_id: r.severity for r in C.tempdb_uniformity(landed).collect()}
    assert u == {"C12.initial_size": "ok", "C12.growth": "ok"}
