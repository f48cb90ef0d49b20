"""Version rule tables (A5-A7) at every interval edge, against the
ladder-shaped DuckDB oracle run on hand-made versions."""

import pytest

from opslens.operators import instance as A
from opslens import suite_cases as SC


def _versions():
    vs = set()
    for major, minor, build, *_ in A.SUPPORT_LATEST_SP:
        mi = {None: "0", "0": "0", "4": "4", "5": "50"}[minor]
        for b in (build - 1, build, build + 1, 0, 1):
            vs.add(f"{major}.{mi}.{b}.0")
    for major, rtm, _ in A.SUPPORT_RTM:
        for b in (rtm - 1, rtm, rtm + 1):
            vs.add(f"{major}.0.{b}.0")
    for major, minor, lo, hi, *_ in A.RISK_RULES:
        mi = minor or "0"
        for b in (lo - 1, lo, hi, hi + 1):
            if b >= 0:
                vs.add(f"{major}.{mi}.{b}.0")
    for major, minor, lo, hi, *_ in A.PATCH_RULES:
        mi = "50" if minor == "5" else "0"
        for b in (lo - 1, lo, min(hi, 99999), min(hi, 99999) + 1):
            if b >= 0:
                vs.add(f"{major}.{mi}.{b}.0")
    vs |= {"11.0.3000.0", "11.1.3000.0", "11.0.3436.0", "11.0.5556.0", "11.0.5569.0", "12.0.2456.0",
           "13.0.4001.0", "10.50.4000.0", "10.0.5828.0", "16.0.1000.0", "7.0.623.0"}
    return sorted(vs)


VERSIONS = _versions()


@pytest.fixture(scope="module")
def instances(spark):
    rows = [(f"s{i}", 0, v) for i, v in enumerate(VERSIONS)]
    return rows, spark.createDataFrame(rows, "server_name string, snapshot_id int, product_version string")


def _duck(duck, rows, body):
    values = ", ".join(f"('{s}', {k}, '{v}')" for s, k, v in rows)
    sql = f"with instances as (select * from (values {values}) t(server_name, snapshot_id, product_version)), " + body
    cur = duck.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


@pytest.mark.parametrize("op,sql", [
    (A.support_level, SC._support_sql()),
    (A.risky_build, SC._risk_sql()),
    (A.side_channel_patch, SC._patch_sql()),
])
def test_rule_edges(spark, duck, instances, op, sql):
    from tools.oracle_check import rows_of
    rows, df = instances
    out = op(spark, df)
    cols, drows = _duck(duck, rows, sql)
    assert sorted(out.columns) == sorted(cols)
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(cols, drows)


def test_rule_intervals_do_not_overlap():
    for rows in (A.support_rules(), A.risk_rules(), A.patch_rules()):
        by = {}
        for r in rows:
            by.setdefault((r[1], r[2], r[5], r[6]), []).append((r[3], r[4]))
        for ivs in by.values():
            ivs.sort()
            for (a_lo, a_hi), (b_lo, b_hi) in zip(ivs, ivs[1:]):
                assert a_hi < b_lo
