"""Gates by platform, version range and option."""

from pyspark.sql import functions as F

from opslens.plans.gates import GATE, gate_table, open_gates

SNAPC = "server_name string, snapshot_id int"


def _instances(spark):
    rows = [("box", 0, "13.0.1.0", 3, False), ("rds", 0, "13.0.1.0", 3, True), ("db", 0, "12.0.1.0", 5, False),
            ("mi", 0, "15.0.1.0", 8, False), ("odd", 0, None, None, None)]
    return spark.createDataFrame(rows, f"{SNAPC}, product_version string, engine_edition int, is_rds boolean")


def _findings(spark, *checks):
    return spark.createDataFrame([(s, 0, c, "ok") for s in ("box", "rds", "db", "mi", "odd", "unknown") for c in checks],
                                 f"{SNAPC}, check_id string, severity string")


def _open(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.check_id, set()).add(r.server_name)
    return out


def test_platforms(spark):
    got = _open(open_gates(_findings(spark, "B7.job_owner", "B10.msdb_size", "D11.never_checked", "C9.x"), _instances(spark), gate_table(spark)))
    everyone = {"box", "rds", "db", "mi", "odd", "unknown"}
    assert got == {"B7.job_owner": everyone - {"rds", "db"}, "B10.msdb_size": everyone - {"db"}, "D11.never_checked": everyone - {"rds"}, "C9.x": everyone}


def test_version_range_edges(spark):
    gates = spark.createDataFrame([("a", None, 13, 15, None), ("b", None, None, 12, None), ("c", "mi", None, None, None), ("d", "azure_mi", 15, None, None),
                                   ("e", "box", 14, None, None)], GATE)
    got = _open(open_gates(_findings(spark, *"abcde"), _instances(spark), gates))
    everyone = {"box", "rds", "db", "mi", "odd", "unknown"}
    assert got == {"a": {"db", "odd", "unknown"}, "b": everyone - {"db"}, "c": everyone, "d": everyone - {"mi"}, "e": everyone}


def test_options_for_all_and_per_server(spark):
    rows, inst, gates = _findings(spark, "listing").drop("check_id"), _instances(spark), spark.createDataFrame(
        [("listing", None, None, None, "settings"), ("listing", "rds", None, None, None)], GATE)
    ask = lambda options: {r.server_name for r in open_gates(rows, inst, gates, options, check=F.lit("listing")).collect()}
    assert ask(()) == {"unknown"}
    assert ask(["settings"]) == {"box", "db", "mi", "odd", "unknown"}
    each = spark.createDataFrame([("box", 0, "settings"), ("rds", 0, "settings"), ("db", 0, "other")], f"{SNAPC}, option string")
    assert ask(each) == {"box", "unknown"}


def test_one_instance_without_fleet_key(spark):
    one = _instances(spark).where("server_name = 'rds'")
    rows = spark.createDataFrame([("D11.never_checked", "ok"), ("C9.x", "ok")], "check_id string, severity string")
    assert [r.check_id for r in open_gates(rows, one, gate_table(spark), keys=[]).collect()] == ["C9.x"]
