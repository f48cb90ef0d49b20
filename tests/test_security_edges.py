"""Permission scripts on hand-made rows: quoting, NULL-skipping concat,
the schema-join parity switch, action order, error rows."""

from opslens.operators import security as S

P = ("server_name string, snapshot_id int, database_name string, principal_id long, name string, type string, "
     "sid long, is_fixed_role boolean, owning_principal_id long, default_schema_name string")


def test_create_user_quotes_and_defaults(spark):
    pr = spark.createDataFrame([
        ("s", 0, "d", 5, "we]ird", "S", 10, False, 1, None),   # SQL user, no schema -> dbo
        ("s", 0, "d", 6, "grp", "G", None, False, 1, None),    # group, no schema -> []
        ("s", 0, "d", 7, "u", "U", 11, False, 1, "sales"),
    ], P)
    lg = spark.createDataFrame([("s", 0, 10, "login]x")], "server_name string, snapshot_id int, sid long, name string")
    st = {r.principal_name: r.statement for r in S.script_users(pr, lg).collect()}
    assert "CREATE USER [we]]ird] FOR LOGIN [login]]x] WITH DEFAULT_SCHEMA = [dbo]" in st["we]ird"]
    assert "CREATE USER [grp] WITHOUT LOGIN WITH DEFAULT_SCHEMA = []" in st["grp"]
    assert st["u"].endswith("WITHOUT LOGIN WITH DEFAULT_SCHEMA = [sales]\nEND")


def test_schema_permission_join_parity(spark):
    perms = spark.createDataFrame([("s", 0, "d", 5, 6, 3, 1, "SL", "G", "SELECT")],
                                  "server_name string, snapshot_id int, database_name string, grantee_principal_id long, "
                                  "grantor_principal_id long, class int, major_id long, type string, state string, "
                                  "permission_name string")
    schemas = spark.createDataFrame([("s", 0, "d", 1, "sales", 9), ("s", 0, "d", 2, "hr", 6)],
                                    "server_name string, snapshot_id int, database_name string, schema_id long, "
                                    "name string, principal_id long")
    pr = spark.createDataFrame([("s", 0, "d", 5, "alice", "S", 1, False, 1, None),
                                ("s", 0, "d", 6, "bob", "S", 2, False, 1, None)], P)
    fixed = [r.statement for r in S.script_schema_permissions(perms, schemas, pr).collect()]
    parity = [r.statement for r in S.script_schema_permissions(perms, schemas, pr, parity=True).collect()]
    assert fixed == ["GRANT SELECT ON SCHEMA::[sales] TO [alice] AS [bob]"]
    assert parity == ["GRANT SELECT ON SCHEMA::[hr] TO [alice] AS [bob]"]  # the source's grantor join


def test_object_permissions_in_fixed_action_order(spark):
    pr = spark.createDataFrame([("s", 0, "d", 5, "alice", "S", 10, False, 1, None)], P)
    lg = spark.createDataFrame([("s", 0, 10, "alice")], "server_name string, snapshot_id int, sid long, name string")
    prot = spark.createDataFrame([("s", 0, "d", 100, 5, a, 205) for a in (26, 224, 196, 197, 195, 193)]
                                 + [("s", 0, "d", 100, 5, 193, 206)],
                                 "server_name string, snapshot_id int, database_name string, id long, uid long, "
                                 "action int, protecttype int")
    ob = spark.createDataFrame([("s", 0, "d", 100, 1, "t")], "server_name string, snapshot_id int, database_name string, "
                               "object_id long, schema_id long, name string")
    sc = spark.createDataFrame([("s", 0, "d", 1, "dbo")], "server_name string, snapshot_id int, database_name string, "
                               "schema_id long, name string")
    st = sorted(r.statement for r in S.script_user_object_permissions(spark, prot, ob, sc, pr, lg).collect())
    assert st == ["DENY\n\tSELECT\n\tON [dbo].[t]\n\tTO alice",
                  "GRANT\n\tSELECT,INSERT,UPDATE,DELETE,EXECUTE,REFERENCES\n\tON [dbo].[t]\n\tTO alice"]


def test_user_without_login_is_an_error_row(spark):
    pr = spark.createDataFrame([("s", 0, "d", 5, "ghost", "S", 99, False, 1, None)], P)
    lg = spark.createDataFrame([], "server_name string, snapshot_id int, sid long, name string")
    r = S.script_user_header(pr, lg, "2024-01-01 00:00:00").collect()[0]
    assert r.severity == "error" and "ghost" in r.statement


def test_none_found_rows_per_database(spark):
    pr = spark.createDataFrame([("s", 0, "d1", 5, "r", "R", None, False, 5, None),
                                ("s", 0, "d2", 5, "u", "S", 1, False, 1, None)], P)
    rows = {(r.database_name, r.statement) for r in S.script_roles(pr, universe=S.database_universe(pr)).collect()}
    assert rows == {("d1", "CREATE ROLE [r] AUTHORIZATION [r]"), ("d2", "/*No database roles found*/")}
