"""Family G — indexes, statistics and procedure cost.

* Facts are pre-aggregated to their join key before meeting a dimension
  (query stats per plan, usage per index), so joins are one-to-one.
* Plan XML is searched whole for statements, at any depth; ``from_xml``
  parses what is found of each.
* Windowed sums over possibly hot groups (one table in many plans) are
  computed as a partial aggregate joined back (adaptive skew-join splits a
  hot partition), never as one window partition holding the hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tsql import money
from ..plans.shape import kcols, spread, top_n
from ..plans.stored import written
from .backup import is_system_db
from .database import live

MIN_PAGES = 1000
MIN_IMPROVEMENT = 10000
MIN_PLAN_USES = 100


def busiest_write_database(io: DataFrame, databases: DataFrame, keys=None) -> DataFrame:
    """G1: per server the online user database (id > 4, state 0, not a
    snapshot) with the most writes."""
    k = kcols(keys)
    io_db = io.groupBy(*k, "database_id").agg(F.sum("num_of_writes").alias("num_of_writes"))
    d = live(databases).filter((F.col("database_id") > 4) & (F.col("state") == 0)) \
        .select(*k, "database_id", F.col("name").alias("database_name"))
    j = io_db.join(d, k + ["database_id"], "inner")
    top = top_n(j, keys, [F.col("num_of_writes").desc(), F.col("database_name")], 1)
    return top.select(*k, "database_name", "num_of_writes", money(F.col("num_of_writes")).alias("num_of_writes_text"))


def index_fragmentation(phys: DataFrame, indexes: DataFrame, objects: DataFrame, schemas: DataFrame,
                        scope: DataFrame | None = None, min_pages: int = MIN_PAGES, keys=None) -> DataFrame:
    """Fragmentation of indexes with at least ``min_pages`` pages, heaps
    excluded; ``scope`` (e.g. G1's result) limits it to one database per
    server by a semi-join."""
    k = kcols(keys)
    p = phys.filter((F.col("page_count") >= min_pages) & (F.lower("index_type_desc") != "heap"))
    if scope is not None:
        p = p.join(scope.select(*k, "database_name"), k + ["database_name"], "left_semi")
    i = indexes.select(*k, "database_name", "object_id", "index_id", F.col("name").alias("index_name"), "fill_factor")
    o = objects.select(*k, "database_name", "object_id", "schema_id", F.col("name").alias("table_name"))
    s = schemas.select(*k, "database_name", "schema_id", F.col("name").alias("schema_name"))
    return p.join(i, k + ["database_name", "object_id", "index_id"], "inner") \
        .join(o, k + ["database_name", "object_id"], "left").join(s, k + ["database_name", "schema_id"], "left").select(
            *k, "database_name", "schema_name", "table_name", "object_id", "index_name", "index_type_desc", "alloc_unit_type_desc",
            "index_depth", "fragmentation_pct", "fragment_count", "avg_fragment_size_in_pages", "page_count",
            "avg_page_space_used_pct", "record_count", "compressed_page_count", "fill_factor")


def statistics_dates(stats: DataFrame, objects: DataFrame, keys=None) -> DataFrame:
    """Statistics, their table and their last update in user databases."""
    k = kcols(keys)
    o = objects.select(*k, "database_name", "object_id", F.col("name").alias("object_name"))
    return stats.filter(~is_system_db("database_name")) \
        .join(o, k + ["database_name", "object_id"], "left").select(
            *k, "database_name", "object_id", "object_name", F.col("name").alias("statistic_name"), F.col("updated").alias("last_updated"))


def missing_indexes(groups: DataFrame, group_stats: DataFrame, details: DataFrame, min_measure: float = MIN_IMPROVEMENT,
                    keys=None) -> DataFrame:
    """Missing-index suggestions whose improvement measure
    cost * impact/100 * (seeks + scans) exceeds ``min_measure``, with the
    CREATE INDEX text (comma only when both column lists exist). The three
    catalogs are joined on near-unique handles: plain equi-joins."""
    k = kcols(keys)
    measure = F.col("avg_total_user_cost") * (F.col("avg_user_impact") / 100.0) * (F.col("user_seeks") + F.col("user_scans"))
    g = group_stats.filter(measure > min_measure).select(
        *k, F.col("group_handle").alias("index_group_handle"), "avg_total_user_cost", "avg_user_impact", "user_seeks", "user_scans", "last_user_seek")
    m = groups.select(*k, "index_group_handle", "index_handle")
    d = details.select(*k, "index_handle", "database_id", "object_id", "object_name", "statement", "equality_columns",
                       "inequality_columns", "included_columns")
    j = g.join(m, k + ["index_group_handle"], "inner").join(d, k + ["index_handle"], "inner")
    eq, ineq, inc = F.col("equality_columns"), F.col("inequality_columns"), F.col("included_columns")
    ddl = F.concat(
        F.lit("CREATE INDEX IX_MI_"), F.col("object_name"), F.lit("_"), F.col("index_group_handle").cast("string"),
        F.lit("_"), F.col("index_handle").cast("string"), F.lit(" ON "), F.col("statement"), F.lit(" ("),
        F.coalesce(eq, F.lit("")), F.when(eq.isNotNull() & ineq.isNotNull(), F.lit(",")).otherwise(F.lit("")),
        F.coalesce(ineq, F.lit("")), F.lit(")"),
        F.coalesce(F.concat(F.lit(" INCLUDE ("), inc, F.lit(")")), F.lit("")))
    text = money(F.col("avg_total_user_cost") * F.col("avg_user_impact") / 100
                 * (F.col("user_seeks") + F.col("user_scans")))
    return j.select(*k, text.alias("improvement_measure"), F.col("statement").alias("table_path"),
                    "avg_total_user_cost", "avg_user_impact", "user_seeks", "user_scans", "last_user_seek", "database_id", "object_id",
                    "index_group_handle", "index_handle", ddl.alias("create_index_statement"))


# Only the parts of a showplan that G5 reads; from_xml ignores the rest.
_GROUP = ("array<struct<_Impact: double, MissingIndex: array<struct<_Database: string, _Schema: string, _Table: string, "
          "ColumnGroup: array<struct<_Usage: string, Column: array<struct<_Name: string>>>>>>>>")
FOUND_SCHEMA = ("Found array<struct<_nested: boolean, StmtSimple: struct<_StatementText: string, "
                f"MissingIndexes: struct<MissingIndexGroup: {_GROUP}>>>>")
# Comments and CDATA (skipped), the tags of statements of any kind, and whole MissingIndexes elements. Elsewhere in
# well-formed XML a "<" is written &lt;, attribute values included; a ">" inside a value is not an end of the tag.
_TAGS = (r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|</Stmt\w+\s*>|<Stmt\w+(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
         r"|<MissingIndexes(?:\s[^>/]*+)?>.*?</MissingIndexes\s*>")
_OPEN = "struct<open: array<string>, found: array<string>>"


def _found_statements(plan: Column) -> Column:
    """The plan's StmtSimple elements with missing indexes, at whatever
    depth, as a flat XML text: the statement's start tag around its own
    MissingIndexes. One pass over the tags keeps the open statements."""
    def step(state, tag):
        opened, found = state["open"], state["found"]
        owner = F.try_element_at(opened, F.lit(-1))
        flat = F.concat(F.lit('<Found nested="'), (F.size(opened) > 1).cast("string"), F.lit('">'), owner, tag, F.lit("</StmtSimple></Found>"))
        closes, opens = tag.startswith("</Stmt"), tag.startswith("<Stmt") & ~tag.endswith("/>")
        return F.struct(
            F.when(closes, F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0)))).when(opens, F.concat(opened, F.array(tag)))
            .otherwise(opened).alias("open"),
            F.when(tag.startswith("<MissingIndexes") & owner.rlike(r"^<StmtSimple[\s>]"), F.concat(found, F.array(flat)))
            .otherwise(found).alias("found"))

    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("found")).cast(_OPEN)
    found = F.aggregate(F.regexp_extract_all(plan, F.lit(_TAGS), F.lit(0)), start, step)["found"]
    return F.concat(F.lit("<Plan>"), F.array_join(found, ""), F.lit("</Plan>"))


def _name_list(groups: Column, usage: str) -> Column:
    cols = F.flatten(F.transform(F.filter(groups, lambda g: g["_Usage"] == usage),
                                 lambda g: F.transform(g["Column"], lambda c: c["_Name"])))
    names = F.array_sort(F.array_distinct(cols))
    return F.when(F.size(names) > 0, F.array_join(names, ", "))


def _clean(c: Column, chars: str) -> Column:
    for ch in chars:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def plan_missing_indexes(plans: DataFrame, keys=None) -> DataFrame:
    """G5 core: one row per statement of a cached plan that carries missing-
    index information. Plans whose text does not mention MissingIndexes are
    skipped before parsing; the others are searched whole, at any depth of
    batches, branches, procedures and functions. ``nested`` flags statements
    that stand inside another statement's body or branch. Missing indexes of
    a condition or cursor belong to no StmtSimple and give no row, as in the
    reference."""
    k = kcols(keys)
    p = spread(plans.filter(F.col("query_plan").contains("MissingIndexes")).select(*k, "usecounts", "query_plan"))
    found = F.from_xml(_found_statements(F.col("query_plan")), FOUND_SCHEMA)["Found"]
    each = F.transform(found, lambda f: F.struct(
        f["StmtSimple"]["_StatementText"].alias("sql_text"), f["StmtSimple"]["MissingIndexes"]["MissingIndexGroup"].alias("groups"),
        f["_nested"].alias("nested")))
    x = p.select(*k, "usecounts", "query_plan", F.inline(F.filter(each, lambda s: F.size(s["groups"]) > 0)))
    mi = F.flatten(F.transform("groups", lambda g: g["MissingIndex"]))
    columns = F.flatten(F.transform(mi, lambda m: m["ColumnGroup"]))
    first = F.try_element_at(mi, F.lit(1))
    return x.select(
        *k,
        F.coalesce(first["_Database"], F.lit("")).alias("database_name"),
        F.coalesce(first["_Schema"], F.lit("")).alias("schema_name"),
        F.coalesce(first["_Table"], F.lit("")).alias("table_name"),
        F.try_element_at("groups", F.lit(1))["_Impact"].alias("impact"),
        "usecounts",
        _name_list(columns, "EQUALITY").alias("equality_columns"),
        _name_list(columns, "INEQUALITY").alias("inequality_columns"),
        _name_list(columns, "INCLUDE").alias("include_columns"),
        F.coalesce("sql_text", F.lit("")).alias("sql_text"), "nested", "query_plan")


def missing_indexes_from_plans(plans: DataFrame, min_uses: int = MIN_PLAN_USES, keys=None, store=None) -> DataFrame:
    """Missing indexes found in cached plans used more than
    ``min_uses`` times, with suggested DDL and the two use totals the source
    orders by (per table, and per table + key column lists).

    Plans are parsed once: the statements have three readers (rows and two
    totals), so they are written as a Parquet table in the shared folder,
    from which the totals read their narrow columns only. ``store`` puts them
    elsewhere (``lambda df: df`` keeps nothing, and parses for each reader)."""
    k = kcols(keys)
    m = plan_missing_indexes(plans.filter(F.col("usecounts") > min_uses), keys)
    m = store(m) if store else written(m)
    # Null-safe grouping keys for the column lists (NULL = no such columns).
    m = m.withColumns({"_eqk": F.coalesce("equality_columns", F.lit("\u0000")),
                       "_inqk": F.coalesce("inequality_columns", F.lit("\u0000"))})
    tkey = k + ["database_name", "schema_name", "table_name"]
    ckey = k + ["table_name", "_eqk", "_inqk"]
    t_uses = m.groupBy(*tkey).agg(F.sum("usecounts").alias("table_uses"))
    c_uses = m.groupBy(*ckey).agg(F.sum("usecounts").alias("pattern_uses"))
    # Joined back by plain equi-joins; a hot table skews a sort-merge
    # partition, which adaptive execution splits (skewJoin) at run time.
    m = m.join(t_uses, tkey, "inner").join(c_uses, ckey, "inner")
    eq, ineq, inc = F.col("equality_columns"), F.col("inequality_columns"), F.col("include_columns")
    cols = F.concat_ws("", F.concat(F.lit(","), eq), F.concat(F.lit(","), ineq))
    ddl = F.concat(
        F.lit("CREATE NONCLUSTERED INDEX IX_"), _clean(F.col("schema_name"), "_[]"), F.lit("_"),
        _clean(F.col("table_name"), "_[]"), F.lit("_"),
        F.coalesce(_clean(eq, "_[], "), F.lit("")), F.coalesce(_clean(F.coalesce(ineq, F.lit("")), "_[], "), F.lit("")),
        F.lit(" ON "), F.col("schema_name"), F.lit("."), F.col("table_name"), F.lit("("),
        F.when(F.length(cols) > 0, F.substring(cols, 2, 1 << 30)), F.lit(")"),
        F.coalesce(F.concat(F.lit(" INCLUDE ("), inc, F.lit(")")), F.lit("")))
    return m.select(*k, "database_name", "schema_name", "table_name", "equality_columns", "inequality_columns",
                    "include_columns", "usecounts", "impact", "sql_text", "nested", "table_uses", "pattern_uses",
                    ddl.alias("potential_ddl"), "query_plan")


def unused_indexes(usage: DataFrame, indexes: DataFrame, objects: DataFrame, schemas: DataFrame,
                   keys=None) -> DataFrame:
    """Named non-clustered indexes of user tables (not primary key, not
    unique constraint) never sought, scanned or looked up; DROP text."""
    k = kcols(keys)
    key = k + ["database_name", "object_id"]
    u = usage.filter(F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups") == 0)
    i = indexes.filter(F.col("name").isNotNull() & ~F.col("is_primary_key") & ~F.col("is_unique_constraint")
                       & (F.col("type_desc") != "CLUSTERED")) \
        .select(*key, "index_id", F.col("name").alias("index_name"))
    o = objects.filter(F.col("type") == "U").select(*key, "schema_id", F.col("name").alias("object_name"))
    s = schemas.select(*k, "database_name", "schema_id", F.col("name").alias("schema_name"))
    j = u.join(i, key + ["index_id"], "inner").join(o, key, "inner") \
        .join(s, k + ["database_name", "schema_id"], "left")
    return j.select(*k, "database_name", "object_name", "object_id", "index_name", "index_id", "user_seeks",
                    "user_scans", "user_lookups", "user_updates",
                    F.concat(F.lit("DROP INDEX "), F.col("schema_name"), F.lit("."), F.col("object_name"), F.lit("."),
                             F.col("index_name"), F.lit(";")).alias("delete_statement"))


def index_column_lists(index_keys: DataFrame, keys=None) -> DataFrame:
    """Per index: key columns ordered by (keyno, colid) and included columns
    ordered by colid, each as a space-separated list."""
    k = kcols(keys)
    key = k + ["database_name", "object_id", "index_id"]
    a = index_keys.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(F.col("keyno") != 0, F.struct("keyno", "colid")))).alias("_k"),
        F.sort_array(F.collect_list(F.when(F.col("keyno") == 0, F.col("colid")))).alias("_i"))
    return a.select(*key, F.array_join(F.transform("_k", lambda x: x["colid"].cast("string")), " ").alias("cols"),
                    F.array_join(F.transform("_i", lambda x: x.cast("string")), " ").alias("inc"))


def duplicate_indexes(indexes: DataFrame, index_keys: DataFrame, objects: DataFrame, schemas: DataFrame,
                      keys=None) -> DataFrame:
    """Indexes of a table with the same key columns, included columns and
    uniqueness (hypothetical indexes and system databases excluded). Each
    group is reported as its first index (lowest id) against every later one,
    so a group of n identical indexes gives n-1 rows, not all pairs."""
    k = kcols(keys)
    ikey = k + ["database_name", "object_id", "index_id"]
    i = indexes.filter(~F.col("is_hypothetical") & ~is_system_db("database_name")) \
        .select(*ikey, "name", "is_unique")
    lists = i.join(index_column_lists(index_keys, keys), ikey, "inner")
    gkey = k + ["database_name", "object_id", "cols", "inc", "is_unique"]
    # A group holds the identical indexes of one table (bounded by the
    # indexes a table can have), so one window pass is safe here.
    w = Window.partitionBy(*gkey)
    dup = lists.withColumns({"index_name": F.min_by("name", "index_id").over(w),
                             "_first": F.min("index_id").over(w)}) \
        .filter(F.col("index_id") > F.col("_first"))
    o = objects.select(*k, "database_name", "object_id", "schema_id", F.col("name").alias("object_name"))
    s = schemas.select(*k, "database_name", "schema_id", F.col("name").alias("schema_name"))
    dup = dup.join(o, k + ["database_name", "object_id"], "left").join(s, k + ["database_name", "schema_id"], "left")
    return dup.select(*k, "database_name", "object_id",
                      F.concat(F.col("schema_name"), F.lit("."), F.col("object_name")).alias("table_name"),
                      "index_name", F.col("name").alias("exact_duplicate"))


def hypothetical_indexes(indexes: DataFrame, objects: DataFrame, schemas: DataFrame, keys=None) -> DataFrame:
    """Hypothetical indexes with a guarded DROP script."""
    k = kcols(keys)
    i = indexes.filter(F.col("is_hypothetical")).select(*k, "database_name", "object_id", F.col("name").alias("index_name"))
    o = objects.select(*k, "database_name", "object_id", "schema_id", F.col("name").alias("object_name"))
    s = schemas.select(*k, "database_name", "schema_id", F.col("name").alias("schema_name"))
    j = i.join(o, k + ["database_name", "object_id"], "inner").join(s, k + ["database_name", "schema_id"], "left")
    tbl = F.concat(F.lit("["), F.col("schema_name"), F.lit("].["), F.col("object_name"), F.lit("]"))
    script = F.concat(F.lit("USE ["), F.col("database_name"), F.lit("]; IF EXISTS (SELECT 1 FROM sys.indexes AS i "
                                                                   "WHERE i.[object_id] = object_id('"),
                      tbl, F.lit("') AND name = '"), F.col("index_name"), F.lit("') DROP INDEX ["),
                      F.col("index_name"), F.lit("] ON "), tbl, F.lit(";"))
    return j.select(*k, "database_name", "index_name", tbl.alias("table_name"), script.alias("drop_script"))


def _proc_base(plans: DataFrame, query_stats: DataFrame, measures: list[str], keys) -> DataFrame:
    """Per-plan sums of the stats (one row per plan), joined 1:1 to cached
    procedure plans; then aggregated per (database, schema, procedure)."""
    k = kcols(keys)
    qs = query_stats.groupBy(*k, "plan_handle").agg(*[F.sum(m).alias(m) for m in measures])
    cp = plans.filter(F.col("db_name").isNotNull() & (F.lower("objtype") == "proc")) \
        .select(*k, "plan_handle", "usecounts", "db_name", "schema_name", "proc_name")
    j = cp.join(qs, k + ["plan_handle"], "inner")
    return j.groupBy(*k, "db_name", "schema_name", "proc_name").agg(
        F.max("usecounts").alias("execution_count"), *[F.sum(m).alias(m) for m in measures])


def procedure_cpu(plans: DataFrame, query_stats: DataFrame, keys=None) -> DataFrame:
    """CPU time per stored procedure, and per execution."""
    b = _proc_base(plans, query_stats, ["total_worker_time"], keys)
    return b.select(*kcols(keys), "db_name", "schema_name", "proc_name", "execution_count",
                    F.col("total_worker_time").alias("total_cpu_time"),
                    (F.col("total_worker_time").cast("double") / F.col("execution_count")).alias("avg_cpu_time"))


def procedure_io(plans: DataFrame, query_stats: DataFrame, keys=None) -> DataFrame:
    """I/O per stored procedure: total (integer average) and physical /
    logical reads and writes (fractional averages)."""
    ms = ["total_physical_reads", "total_logical_reads", "total_logical_writes"]
    b = _proc_base(plans, query_stats, ms, keys)
    tot = F.col("total_physical_reads") + F.col("total_logical_reads") + F.col("total_logical_writes")
    n = F.col("execution_count")
    return b.select(*kcols(keys), "db_name", "schema_name", "proc_name", "execution_count", tot.alias("total_io"),
                    F.call_function("div", tot, n).alias("avg_total_io"),
                    "total_physical_reads", (F.col("total_physical_reads").cast("double") / n).alias("avg_physical_read"),
                    "total_logical_reads", (F.col("total_logical_reads").cast("double") / n).alias("avg_logical_read"),
                    "total_logical_writes", (F.col("total_logical_writes").cast("double") / n).alias("avg_logical_writes"))


def procedure_elapsed(plans: DataFrame, query_stats: DataFrame, keys=None) -> DataFrame:
    """Elapsed time per stored procedure (integer average)."""
    b = _proc_base(plans, query_stats, ["total_elapsed_time"], keys)
    return b.select(*kcols(keys), "db_name", "schema_name", "proc_name", "execution_count", "total_elapsed_time",
                    F.call_function("div", F.col("total_elapsed_time"), F.col("execution_count")).alias("avg_elapsed_time"))
