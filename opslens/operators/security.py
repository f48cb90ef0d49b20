"""Family J — access audit and generated permission scripts.

Re-aimed as a fleet access audit: each operator returns structured rows
(fleet key, database, section, principal / object, ...) plus the generated
statement as one derived column; nothing is ever executed. A database in the
``universe`` with nothing to script gets one ``info`` row ("none found"), as
the source prints. Passwords are arguments (placeholders), never literals.

Rows carry ``seq``, the place of their statement in the database's section
(by principal, object and statement; NULL first). A section can hold a large
share of all rows, so it is numbered by ranges (``plans.numbering``); the
same counts tell which databases have nothing to script, so every section's
rows are computed once. ``draft=True`` gives them before numbering, for
``access_audit``, which numbers all sections together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tsql import quotename
from ..plans.numbering import numbered
from ..plans.shape import kcols, kjoin

PASSWORD_PLACEHOLDER = "<password>"
# Object permission action codes, in script order.
ACTIONS = [(193, "SELECT", 1), (195, "INSERT", 2), (197, "UPDATE", 3), (196, "DELETE", 4),
           (224, "EXECUTE", 5), (26, "REFERENCES", 6)]
GRANT_TYPE, DENY_TYPE = 205, 206
# Permission state code -> state description.
STATE_DESC = {"G": "GRANT", "D": "DENY", "W": "GRANT_WITH_GRANT_OPTION", "R": "REVOKE"}
NL = "\n"


def cat(*parts) -> Column:
    """Concatenation that skips NULLs (the scripts run with
    CONCAT_NULL_YIELDS_NULL OFF)."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def state_desc(c: Column) -> Column:
    out = None
    for code, desc in STATE_DESC.items():
        out = F.when(c == code, desc) if out is None else out.when(c == code, desc)
    return out


# What a section without rows says.
NONE_FOUND = {
    "certificates": "/*No certificates found*/",
    "users": "/*No database users found*/",
    "certificate_users": "/*No certificated users found*/",
    "roles": "/*No database roles found*/",
    "application_roles": "/*No application roles found*/",
    "nested_roles": "/*No nested roles found*/",
    "database_grants": "/*No database connection GRANTS found*/",
    "object_grants": "/*No database user object GRANTS found*/",
    "role_members": "/*No database user role GRANTS found*/",
}
ORPHANS = "orphan_users"


def _out(df: DataFrame, keys, section: str, principal: Column, obj: Column, stmt: Column,
         severity: Column | str = "info", none: bool = False) -> DataFrame:
    """Draft rows of a section; ``none`` marks those that stand for an empty one."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(*kcols(keys), "database_name", F.lit(section).alias("section"), sev.alias("severity"),
                     principal.cast("string").alias("principal_name"), obj.cast("string").alias("object_name"),
                     stmt.alias("statement"), F.lit(none).alias("_none"))


def none_found(universe: DataFrame, keys, sections: list[str]) -> DataFrame:
    """For each database of ``universe`` (fleet key + database_name) and each
    of the ``sections``, the row that holds if the section has no other."""
    texts = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(NONE_FOUND[s]).alias("text")) for s in sections]))
    k = kcols(keys)
    rows = universe.select(*k, "database_name").distinct().withColumn("_t", texts)
    nothing = F.lit(None).cast("string")
    return rows.select(*k, "database_name", F.col("_t.section").alias("section"), F.lit("info").alias("severity"),
                       nothing.alias("principal_name"), nothing.alias("object_name"), F.col("_t.text").alias("statement"),
                       F.lit(True).alias("_none"))


def in_order(drafts: DataFrame, keys=None) -> DataFrame:
    """Number the statements of every (database, section); a "none found" row
    stays only where it is the section's only one."""
    section = [*kcols(keys), "database_name", "section"]
    rows = numbered(drafts, section, ["_none", "principal_name", "object_name", "statement"], seq="seq", total="_n")
    return rows.where(~F.col("_none") | (F.col("_n") == 1)).drop("_none", "_n")


def _section(rows: DataFrame, universe: DataFrame | None, keys, section: str, draft: bool) -> DataFrame:
    if draft:
        return rows
    if universe is not None:
        rows = rows.unionByName(none_found(universe, keys, [section]))
    return in_order(rows, keys)


def database_universe(principals: DataFrame, keys=None) -> DataFrame:
    """Databases known to the audit: those with any principal row."""
    return principals.select(*kcols(keys), "database_name").distinct()


def script_certificates(certs: DataFrame, password: str = PASSWORD_PLACEHOLDER, universe=None,
                        keys=None, draft: bool = False) -> DataFrame:
    """CREATE CERTIFICATE with subject and expiry (style 120)."""
    stmt = F.concat(F.lit("CREATE CERTIFICATE "), F.col("name"), F.lit(f" ENCRYPTION BY PASSWORD = '{password}'"
                                                                      " WITH SUBJECT = '"),
                    F.col("issuer_name"), F.lit("', EXPIRY_DATE = '"),
                    F.date_format("expiry_date", "yyyy-MM-dd HH:mm:ss"), F.lit("'"))
    rows = _out(certs, keys, "certificates", F.lit(None), F.col("name"), stmt)
    return _section(rows, universe, keys, "certificates", draft)


def script_users(principals: DataFrame, logins: DataFrame, universe=None, keys=None, draft: bool = False) -> DataFrame:
    """Guarded CREATE USER for SQL/Windows users and groups (id > 4):
    FOR LOGIN when the SID maps to a login, else WITHOUT LOGIN; default schema
    dbo when unset (groups without one print ``[]``)."""
    k = kcols(keys)
    u = principals.filter(F.col("type").isin("U", "G", "S") & (F.col("principal_id") > 4))
    lg = logins.select(*k, "sid", F.col("name").alias("login_name"))
    j = u.join(lg, k + ["sid"], "left")
    stmt = cat("IF (SELECT name FROM sys.database_principals WHERE name = '", F.col("name"), "') IS NULL", NL,
               "BEGIN", NL, "CREATE USER ", quotename(F.col("name")),
               F.when(F.col("login_name").isNull(), F.lit(" WITHOUT LOGIN"))
               .otherwise(F.concat(F.lit(" FOR LOGIN "), quotename(F.col("login_name")))),
               F.when(F.col("default_schema_name").isNull() & (F.col("type") != "G"),
                      F.lit(" WITH DEFAULT_SCHEMA = [dbo]"))
               .otherwise(cat(" WITH DEFAULT_SCHEMA = [", F.col("default_schema_name"), "]")), NL, "END")
    rows = _out(j, keys, "users", F.col("name"), F.lit(None), stmt)
    return _section(rows, universe, keys, "users", draft)


def script_certificate_users(principals: DataFrame, certs: DataFrame, universe=None, keys=None, draft: bool = False) -> DataFrame:
    """Users mapped to a certificate (type C, id > 4, SID match)."""
    k = kcols(keys)
    p = principals.filter((F.col("type") == "C") & (F.col("principal_id") > 4))
    c = certs.select(*k, "database_name", "sid", F.col("name").alias("cert_name"))
    j = p.join(c, k + ["database_name", "sid"], "inner")
    rows = _out(j, keys, "certificate_users", F.col("name"), F.col("cert_name"),
                cat("CREATE USER ", quotename(F.col("name")), " FOR CERTIFICATE ", F.col("cert_name")))
    return _section(rows, universe, keys, "certificate_users", draft)


def script_schema_permissions(perms: DataFrame, schemas: DataFrame, principals: DataFrame,
                              parity: bool = False, keys=None, draft: bool = False) -> DataFrame:
    """Schema-class (3) permissions: STATE PERMISSION ON SCHEMA::[s] TO
    [grantee] AS [grantor]. The schema is matched on the permission's
    major_id; ``parity=True`` reproduces the source's match on the grantor."""
    k = kcols(keys)
    p = perms.filter(F.col("class") == 3)
    s = schemas.select(*k, "database_name", F.col("schema_id").alias("_sid"), F.col("principal_id").alias("_spid"),
                       F.col("name").alias("schema_name"))
    on = F.col("grantor_principal_id") == F.col("_spid") if parity else F.col("major_id") == F.col("_sid")
    j = p.join(s, k + ["database_name"], "inner").filter(on)
    pr = principals.select(*k, "database_name", "principal_id", "name")
    j = j.join(pr.withColumnsRenamed({"principal_id": "grantee_principal_id", "name": "grantee"}),
               k + ["database_name", "grantee_principal_id"], "inner") \
        .join(pr.withColumnsRenamed({"principal_id": "grantor_principal_id", "name": "grantor"}),
              k + ["database_name", "grantor_principal_id"], "inner")
    stmt = cat(state_desc(F.col("state")), " ", F.col("permission_name"), " ON SCHEMA::", quotename(F.col("schema_name")),
               " TO ", quotename(F.col("grantee")), " AS ", quotename(F.col("grantor")))
    return _section(_out(j, keys, "schema_permissions", F.col("grantee"), F.col("schema_name"), stmt), None, keys, "schema_permissions", draft)


def script_roles(principals: DataFrame, universe=None, keys=None, draft: bool = False) -> DataFrame:
    """User-defined database roles with their owner (self-join)."""
    k = kcols(keys)
    r = principals.filter((F.col("type") == "R") & ~F.col("is_fixed_role") & (F.col("principal_id") > 4))
    own = principals.select(*k, "database_name", F.col("principal_id").alias("owning_principal_id"),
                            F.col("name").alias("owner_name"))
    j = r.join(own, k + ["database_name", "owning_principal_id"], "inner")
    rows = _out(j, keys, "roles", F.col("name"), F.lit(None),
                cat("CREATE ROLE ", quotename(F.col("name")), " AUTHORIZATION ", quotename(F.col("owner_name"))))
    return _section(rows, universe, keys, "roles", draft)


def script_app_roles(principals: DataFrame, password: str = PASSWORD_PLACEHOLDER, universe=None,
                     keys=None, draft: bool = False) -> DataFrame:
    """Application roles (type A, not fixed, id > 4)."""
    a = principals.filter((F.col("type") == "A") & ~F.col("is_fixed_role") & (F.col("principal_id") > 4))
    rows = _out(a, keys, "application_roles", F.col("name"), F.lit(None),
                cat("CREATE APPLICATION ROLE ", F.col("name"), " WITH DEFAULT_SCHEMA = ",
                    quotename(F.col("default_schema_name")), f", PASSWORD = N'{password}'"))
    return _section(rows, universe, keys, "application_roles", draft)


def _memberships(principals: DataFrame, members: DataFrame, keys) -> DataFrame:
    k = kcols(keys)
    pr = principals.select(*k, "database_name", "principal_id", "name", "type")
    return members.join(pr.withColumnsRenamed({"principal_id": "member_principal_id", "name": "member_name",
                                               "type": "member_type"}),
                        k + ["database_name", "member_principal_id"], "inner") \
        .join(pr.withColumnsRenamed({"principal_id": "role_principal_id", "name": "role_name", "type": "role_type"}),
              k + ["database_name", "role_principal_id"], "inner")


def _addrolemember(role: Column, member: Column) -> Column:
    return cat("EXEC sp_addrolemember '", role, "', '", member, "'")


def script_nested_roles(principals: DataFrame, members: DataFrame, universe=None, keys=None, draft: bool = False) -> DataFrame:
    """Roles that are members of other roles."""
    j = _memberships(principals, members, keys).filter(F.col("member_type") == "R")
    rows = _out(j, keys, "nested_roles", F.col("member_name"), F.col("role_name"),
                _addrolemember(F.col("role_name"), F.col("member_name")))
    return _section(rows, universe, keys, "nested_roles", draft)


def script_database_grants(perms: DataFrame, principals: DataFrame, universe=None, keys=None, draft: bool = False) -> DataFrame:
    """Database-class (0) permissions of principals with id > 4."""
    k = kcols(keys)
    pr = principals.filter(F.col("principal_id") > 4).select(
        *k, "database_name", F.col("principal_id").alias("grantee_principal_id"), F.col("name").alias("grantee"))
    j = perms.filter(F.col("class") == 0).join(pr, k + ["database_name", "grantee_principal_id"], "inner")
    rows = _out(j, keys, "database_grants", F.col("grantee"), F.lit(None),
                cat(state_desc(F.col("state")), " ", F.col("permission_name"), " TO ", quotename(F.col("grantee"))))
    return _section(rows, universe, keys, "database_grants", draft)


def script_object_grants(perms: DataFrame, principals: DataFrame, objects: DataFrame, schemas: DataFrame,
                         universe=None, keys=None, draft: bool = False) -> DataFrame:
    """Object permissions (object types other than IT, S, X); 'W' state
    becomes GRANT ... WITH GRANT OPTION. Rows are distinct (the source's
    print-and-delete loop)."""
    k = kcols(keys)
    d = k + ["database_name"]
    pr = principals.select(*d, F.col("principal_id").alias("grantee_principal_id"), F.col("name").alias("grantee"))
    ob = objects.filter(~F.col("type").isin("IT", "S", "X")).select(
        *d, F.col("object_id").alias("major_id"), "schema_id", F.col("name").alias("obj_name"))
    sc = schemas.select(*d, "schema_id", F.col("name").alias("schema_name"))
    j = perms.join(pr, d + ["grantee_principal_id"], "inner").join(ob, d + ["major_id"], "inner") \
        .join(sc, d + ["schema_id"], "inner")
    w = F.col("state") == "W"
    rows = j.select(*d, F.when(w, "GRANT").otherwise(state_desc(F.col("state"))).alias("_state"),
                    "permission_name", "schema_name", "obj_name", "grantee",
                    F.when(w, "] WITH GRANT OPTION").otherwise("]").alias("_suffix")).distinct()
    stmt = cat(F.col("_state"), " ", F.col("permission_name"), " ON [", F.col("schema_name"), "].[", F.col("obj_name"),
               "] TO [", F.col("grantee"), F.col("_suffix"))
    out = _out(rows.withColumns({"_p": F.col("grantee"), "_o": F.col("obj_name"), "_s": stmt}), keys,
               "object_grants", F.col("_p"), F.col("_o"), F.col("_s"))
    return _section(out, universe, keys, "object_grants", draft)


def script_role_members(principals: DataFrame, members: DataFrame, universe=None, keys=None, draft: bool = False) -> DataFrame:
    """Role memberships of non-role principals with id > 4."""
    j = _memberships(principals, members, keys).filter((F.col("member_principal_id") > 4)
                                                       & (F.col("member_type") != "R"))
    rows = _out(j, keys, "role_members", F.col("member_name"), F.col("role_name"),
                _addrolemember(F.col("role_name"), F.col("member_name")))
    return _section(rows, universe, keys, "role_members", draft)


def login_users(principals: DataFrame) -> DataFrame:
    """Users mapped to logins (SQL or Windows), other than dbo and guest."""
    return principals.filter(F.col("type").isin("S", "U", "G") & F.col("sid").isNotNull()
                             & ~F.col("name").isin("dbo", "guest"))


def script_user_header(principals: DataFrame, logins: DataFrame, as_of, created_by: str = "opslens",
                       keys=None, draft: bool = False) -> DataFrame:
    """Per login user the script header (grant database access); a user
    whose SID has no login gets an ``error`` row instead."""
    k = kcols(keys)
    u = login_users(principals)
    lg = logins.select(*k, "sid", F.col("name").alias("login_name"))
    j = u.join(lg, k + ["sid"], "left")
    ts = F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyyMMddHHmmss")
    header = F.concat(F.lit("--Security creation script for user "), F.col("login_name"), F.lit(NL + "--Created At: "),
                      ts, F.lit(f"{NL}--Created By: {created_by}{NL}--Add User To Database{NL}USE ["),
                      F.col("database_name"), F.lit(f"]{NL}EXEC [sp_grantdbaccess]{NL}\t@loginame = '"), F.col("name"),
                      F.lit(f"',{NL}\t@name_in_db = '"), F.col("name"), F.lit(f"'{NL}--{NL}--Add User To Roles"))
    err = F.concat(F.lit("User "), F.col("name"), F.lit(" has no login on this server (database "),
                   F.col("database_name"), F.lit(")"))
    missing = F.col("login_name").isNull()
    rows = _out(j, keys, "user_header", F.col("name"), F.lit(None), F.when(missing, err).otherwise(header),
                severity=F.when(missing, "error").otherwise("info"))
    return _section(rows, None, keys, "user_header", draft)


def script_user_roles(principals: DataFrame, logins: DataFrame, members: DataFrame, keys=None, draft: bool = False) -> DataFrame:
    """For each login user, the roles it is a member of."""
    k = kcols(keys)
    u = login_users(principals).join(logins.select(*k, "sid"), k + ["sid"], "left_semi") \
        .select(*k, "database_name", F.col("principal_id").alias("member_principal_id"), F.col("name").alias("user_name"))
    roles = principals.select(*k, "database_name", F.col("principal_id").alias("role_principal_id"),
                              F.col("name").alias("role_name"))
    j = members.join(u, k + ["database_name", "member_principal_id"], "inner") \
        .join(roles, k + ["database_name", "role_principal_id"], "inner")
    stmt = F.concat(F.lit(f"EXEC [sp_addrolemember]{NL}\t@rolename = '"), F.col("role_name"),
                    F.lit(f"',{NL}\t@membername = '"), F.col("user_name"), F.lit("'"))
    return _section(_out(j, keys, "user_roles", F.col("user_name"), F.col("role_name"), stmt), None, keys, "user_roles", draft)


def script_user_object_permissions(spark, protects: DataFrame, objects: DataFrame, schemas: DataFrame,
                                   principals: DataFrame, logins: DataFrame, keys=None, draft: bool = False) -> DataFrame:
    """Per login user and object, one GRANT and/or one DENY statement
    listing the granted (205) or denied (206) actions in fixed order."""
    from ..plans.shape import dim
    k = kcols(keys)
    d = k + ["database_name"]
    u = login_users(principals).join(logins.select(*k, "sid"), k + ["sid"], "left_semi") \
        .select(*d, F.col("principal_id").alias("uid"), F.col("name").alias("user_name"))
    acts = dim(spark, ACTIONS, "action int, action_name string, action_order int")
    p = protects.filter(F.col("protecttype").isin(GRANT_TYPE, DENY_TYPE)) \
        .join(acts, "action", "inner").join(u, d + ["uid"], "inner")
    g = p.groupBy(*d, "uid", "user_name", "id", "protecttype").agg(
        F.array_sort(F.collect_set(F.struct("action_order", "action_name"))).alias("_a"))
    ob = objects.select(*d, F.col("object_id").alias("id"), "schema_id", F.col("name").alias("obj_name"))
    sc = schemas.select(*d, "schema_id", F.col("name").alias("schema_name"))
    j = g.join(ob, d + ["id"], "inner").join(sc, d + ["schema_id"], "left")
    obj = F.concat(F.lit("["), F.col("schema_name"), F.lit("].["), F.col("obj_name"), F.lit("]"))
    verb = F.when(F.col("protecttype") == GRANT_TYPE, "GRANT").otherwise("DENY")
    stmt = F.concat(verb, F.lit(NL + "\t"), F.array_join(F.transform("_a", lambda x: x["action_name"]), ","),
                    F.lit(NL + "\tON "), obj, F.lit(NL + "\tTO "), F.col("user_name"))
    return _section(_out(j, keys, "user_object_permissions", F.col("user_name"), obj, stmt), None, keys, "user_object_permissions", draft)


def eligible_databases(databases: DataFrame, instances: DataFrame, keys=None) -> DataFrame:
    """Online, multi-user, writable user databases (id > 4) whose
    collation is the server's (= master's) collation."""
    k = kcols(keys)
    srv = instances.select(*k, F.col("collation").alias("_server_collation"))
    return kjoin(databases, srv, k, "inner") \
        .filter((F.col("collation_name") == F.col("_server_collation")) & (F.col("database_id") > 4)
                & (F.col("user_access") == 0) & ~F.col("is_read_only") & (F.lower("state_desc") == "online")) \
        .select(*k, F.col("name").alias("database_name"))


def orphan_users(principals: DataFrame, server_principals: DataFrame, databases: DataFrame,
                 instances: DataFrame, keys=None, draft: bool = False) -> DataFrame:
    """SQL users (SID set and not 0x0) whose SID matches no login while a
    login of the same name exists, in each eligible database; an eligible
    database without any gets one info row."""
    k = kcols(keys)
    elig = eligible_databases(databases, instances, keys)
    users = principals.filter((F.col("type") == "S") & F.col("sid").isNotNull() & (F.col("sid") != 0)) \
        .join(elig, k + ["database_name"], "left_semi")
    sp_names = server_principals.select(*k, "name").distinct()
    sp_sids = server_principals.select(*k, "sid").distinct()
    o = users.join(sp_names, k + ["name"], "left_semi").join(sp_sids, k + ["sid"], "left_anti")
    rows = _out(o, keys, ORPHANS, F.col("name"), F.lit(None),
                F.concat(F.col("name"), F.lit(" is an orphaned user (login exists, SID differs)")), severity="warn")
    none = _out(elig.distinct(), keys, ORPHANS, F.lit(None), F.lit(None),
                F.concat(F.lit("No orphan user to be fixed for "), F.col("database_name")), none=True)
    rows = rows.unionByName(none)
    return rows if draft else in_order(rows, keys)
