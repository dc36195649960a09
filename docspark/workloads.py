"""The catalogue of registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import documents as docmode
from .functions import hashes, scoring
from .functions.predicates import predicate
from .operators import index, records, replay
from .plans.query import Query
from .sources import sealed, snapshots

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, name: str) -> Query:
    return Query(table(spark, sf_dir, name), tuple(KEYS.get(name, ())))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["top_orders"](spark, sf_dir)


def _query(sql: str | None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _filtered(name: str, source: str, tests: list[tuple], columns: list[str], sql_where: str, derive: dict | None = None):
    """A query that filters ``source``; ``derive`` maps new columns to (Spark SQL, DuckDB SQL)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        for column, (expression, _) in (derive or {}).items():
            rows = rows.withColumn(column, F.expr(expression))
        query = Query(rows, tuple(KEYS.get(source, ())))
        for test in tests:
            query = query.where(*test)
        return query.select(*columns).find()

    inner = "".join(f", {sql} AS {column}" for column, (_, sql) in (derive or {}).items())
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {', '.join(columns)} FROM (SELECT *{inner} FROM {source}) WHERE {sql_where}"


O = ["o_orderkey", "o_orderstatus", "o_totalprice"]  # noqa: E741
C = ["c_custkey", "c_name", "c_acctbal"]
NULLED = {"kind": ("nullif(event_type, 'error')", "nullif(event_type, 'error')")}
NULLED_VALUE = {"amount": ("nullif(value, 0) * if(event_type = 'view', null, 1)", "CASE WHEN event_type = 'view' THEN NULL ELSE nullif(value, 0) END")}
WORDS = {"words": ("split(p_name, ' ')", "string_split(p_name, ' ')")}
E_ = ["event_id", "kind"]

_filtered("eq_string", "orders", [("o_orderstatus", "==", "F")], O, "o_orderstatus = 'F'")
_filtered("eq_number", "lineitem", [("l_quantity", "=", 10)], ["l_orderkey", "l_partkey", "l_quantity"], "l_quantity = 10")
_filtered("eq_two_arguments", "nation", [("n_regionkey", 2)], ["n_nationkey", "n_name"], "n_regionkey = 2")
_filtered("eq_type_strict", "orders", [("o_orderkey", "==", "1")], O, "false")
_filtered("ne_string", "orders", [("o_orderstatus", "!=", "F")], O, "o_orderstatus IS DISTINCT FROM 'F'")
_filtered("ne_missing_is_true", "events", [("kind", "!=", "click")], E_, "kind IS DISTINCT FROM 'click'", NULLED)
_filtered("eq_null_is_missing", "events", [("kind", "==", None)], ["event_id"], "kind IS NULL", NULLED)
_filtered("ne_null", "events", [("kind", "!=", None)], E_, "kind IS NOT NULL", NULLED)
_filtered("gt_number", "orders", [("o_totalprice", ">", 100000)], O, "o_totalprice > 100000")
_filtered("ge_number", "customer", [("c_acctbal", ">=", 5000.5)], C, "c_acctbal >= 5000.5")
_filtered("lt_number", "customer", [("c_acctbal", "<", 0)], C, "c_acctbal < 0 OR c_acctbal IS NULL")
_filtered("le_number", "lineitem", [("l_quantity", "<=", 2)], ["l_orderkey", "l_partkey", "l_quantity"], "l_quantity <= 2")
_filtered("gt_missing_never", "events", [("amount", ">", 50)], ["event_id"], "amount > 50", NULLED_VALUE)
_filtered("lt_missing_always", "events", [("amount", "<", 50)], ["event_id"], "amount IS NULL OR amount < 50", NULLED_VALUE)
_filtered("le_missing_always", "events", [("amount", "<=", 50)], ["event_id"], "amount IS NULL OR amount <= 50", NULLED_VALUE)
_filtered("ge_missing_never", "events", [("amount", ">=", 50)], ["event_id"], "amount >= 50", NULLED_VALUE)
_filtered("gt_string_collated", "part", [("p_name", ">", "part 5")], ["p_partkey", "p_name"], "p_name COLLATE en > 'part 5'")
_filtered("le_string_collated", "nation", [("n_name", "<=", "NATION_15")], ["n_nationkey", "n_name"], "n_name COLLATE en <= 'NATION_15'")
_filtered("string_column_below_number", "orders", [("o_orderstatus", "<", 5)], O, "true")
_filtered("string_column_below_negative", "events", [("kind", "<", -5)], ["event_id"], "kind IS NULL", NULLED)
_filtered("number_column_above_string", "customer", [("c_acctbal", ">", "s")], C, "c_acctbal >= 0")
_filtered("number_column_below_string", "customer", [("c_acctbal", "<", "s")], C, "c_acctbal < 0 OR c_acctbal IS NULL")
_filtered("number_column_below_null", "supplier", [("s_acctbal", "<", None)], ["s_suppkey"], "true")
_filtered("number_column_above_null", "supplier", [("s_acctbal", ">", None)], ["s_suppkey"], "false")
_filtered("boolean_column_order", "orders", [("big", ">", False)], O, "big", {"big": ("o_totalprice > 1e5", "o_totalprice > 1e5")})
_filtered("boolean_column_above_null", "orders", [("big", ">=", None)], O, "big", {"big": ("o_totalprice > 1e5", "o_totalprice > 1e5")})
_filtered("contains_string", "documents", [("text", "contains", "All rights reserved")], ["doc_id", "source"], "contains(text, 'All rights reserved')")
_filtered("contains_array", "part", [("words", "contains", "widget")], ["p_partkey"], "list_contains(words, 'widget')", WORDS)
_filtered("contains_array_other_type", "part", [("words", "contains", 5)], ["p_partkey"], "false", WORDS)
_filtered("starts_with", "nation", [("n_name", "startsWith", "N")], ["n_nationkey", "n_name"], "starts_with(n_name, 'N')")
_filtered("ends_with", "part", [("p_type", "endsWith", "L")], ["p_partkey", "p_type"], "ends_with(p_type, 'L')")
_filtered("in_list", "orders", [("o_orderpriority", "in", ["1-URGENT", "5-LOW", 7])], O, "o_orderpriority IN ('1-URGENT', '5-LOW')")
_filtered("in_list_with_null", "events", [("kind", "in", ["click", None])], ["event_id"], "kind = 'click' OR kind IS NULL", NULLED)
_filtered("in_scalar_is_false", "orders", [("o_orderstatus", "in", "F")], O, "false")
_filtered("nested_struct_path", "customer", [("profile.segment", "==", "BUILDING")], ["c_custkey"], "c_mktsegment = 'BUILDING'", {"profile": ("named_struct('segment', c_mktsegment)", "1")})
_filtered("path_through_scalar_is_missing", "customer", [("c_name.first", "==", None)], ["c_custkey"], "true")
_filtered("path_through_array_is_missing", "part", [("words.0", "!=", "x")], ["p_partkey"], "true", WORDS)
_filtered(
    "conjunction", "lineitem",
    [("l_returnflag", "==", "R"), ("l_quantity", ">=", 45), ("l_discount", "<", 0.03)],
    ["l_orderkey", "l_partkey", "l_quantity", "l_discount"],
    "l_returnflag = 'R' AND l_quantity >= 45 AND l_discount < 0.03",
)


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, sf_dir):
    found = collection(spark, sf_dir, "orders").where("o_orderstatus", "F").and_("o_totalprice", ">=", 100000)
    return found.sort("o_totalprice", "desc").take(10).select("o_orderkey", "o_totalprice").find()


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 15")
def sort_skip_take(spark, sf_dir):
    return collection(spark, sf_dir, "customer").sort("c_acctbal").skip(15).take(20).select("c_custkey", "c_acctbal").find()


@_query("SELECT c_custkey, c_name FROM customer ORDER BY c_name COLLATE en DESC, c_custkey LIMIT 25")
def sort_string_descending(spark, sf_dir):
    return collection(spark, sf_dir, "customer").sort("c_name", "desc").take(25).select("c_custkey", "c_name").find()


@_query("SELECT event_id FROM (SELECT *, nullif(event_type, 'error') AS kind FROM events) ORDER BY kind COLLATE en ASC NULLS FIRST, event_id LIMIT 50")
def sort_missing_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("kind", F.expr("nullif(event_type, 'error')"))
    return Query(rows, ("event_id",)).sort("kind").take(50).select("event_id").find()


@_query("SELECT event_id FROM (SELECT *, nullif(event_type, 'error') AS kind FROM events) ORDER BY kind COLLATE en DESC NULLS LAST, event_id LIMIT 50")
def sort_missing_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("kind", F.expr("nullif(event_type, 'error')"))
    return Query(rows, ("event_id",)).sort("kind", "desc").take(50).select("event_id").find()


@_query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def first_match(spark, sf_dir):
    query = collection(spark, sf_dir, "orders").where("o_orderpriority", "5-LOW").sort("o_totalprice", "desc")
    return query.select("o_orderkey").first()


@_query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return records.get(table(spark, sf_dir, "orders"), 7, "o_orderkey")


@_query("SELECT r_regionkey, r_name FROM region")
def full_scan(spark, sf_dir):
    return collection(spark, sf_dir, "region").find()


@_query("SELECT r_regionkey FROM region WHERE false")
def take_zero(spark, sf_dir):
    return collection(spark, sf_dir, "region").take(0).select("r_regionkey").find()


@_query("SELECT count(*) AS n FROM lineitem")
def count_all(spark, sf_dir):
    return collection(spark, sf_dir, "lineitem").count()


@_query("SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'")
def count_filtered(spark, sf_dir):
    import datetime

    return collection(spark, sf_dir, "lineitem").where("l_shipdate", ">=", datetime.datetime(1997, 1, 1)).count()


@_query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_ignores_limit(spark, sf_dir):
    return collection(spark, sf_dir, "orders").where("o_orderstatus", "O").take(3).skip(1).count()


@_query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS records FROM {t}" for t in TABLES))
def collection_info(spark, sf_dir):
    return snapshots.collection_sizes({t: table(spark, sf_dir, t) for t in TABLES})


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90")
def document_path_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(docmode.doc_predicate(F.col("props"), "k", ">=", 90))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_query("SELECT count(*) AS n FROM events")
def document_absent_path(spark, sf_dir):
    return table(spark, sf_dir, "events").where(docmode.doc_predicate(F.col("props"), "zz", "==", None)).agg(F.count("*").alias("n"))


@_query("SELECT event_id FROM events ORDER BY CAST(json_extract(props, '$.k') AS DOUBLE) DESC, event_id LIMIT 30")
def document_path_sort(spark, sf_dir):
    keys = docmode.order(F.col("props"), "k", descending=True)
    return table(spark, sf_dir, "events").orderBy(*keys, "event_id").limit(30).select("event_id")


ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*ORDER.split(", "))


@_query(f"SELECT {ORDER} FROM orders UNION ALL SELECT -o_orderkey, o_custkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 50 = 3")
def insert_records(spark, sf_dir):
    base = _orders(spark, sf_dir)
    new = base.where("o_orderkey % 50 = 3").withColumn("o_orderkey", -F.col("o_orderkey")).withColumn("o_orderstatus", F.lit("N"))
    return records.insert(base, new, key="o_orderkey")


@_query(
    f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 1 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders"
    " UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'Z', o_totalprice FROM orders WHERE o_orderkey % 11 = 2"
)
def put_records(spark, sf_dir):
    base = _orders(spark, sf_dir)
    new = base.where("o_orderkey % 7 = 1").unionByName(base.where("o_orderkey % 11 = 2").withColumn("o_orderkey", F.col("o_orderkey") + 100000000))
    return records.put(base, new.withColumn("o_orderstatus", F.lit("Z")), key="o_orderkey")


@_query(
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus,"
    " CASE WHEN o_orderkey % 10 = 2 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders"
)
def update_records(spark, sf_dir):
    base = _orders(spark, sf_dir)
    patch = base.where("o_orderkey % 10 in (1, 2)").select(
        "o_orderkey",
        F.expr("if(o_orderkey % 10 = 1, array('o_orderstatus'), array('o_totalprice'))").alias("present"),
        F.lit(None).cast("string").alias("o_orderstatus"),
        F.lit(0.0).alias("o_totalprice"),
    )
    return records.update(base, patch, key="o_orderkey")


@_query(f"SELECT {ORDER} FROM orders WHERE o_custkey % 3 <> 0")
def delete_records(spark, sf_dir):
    base = _orders(spark, sf_dir)
    return records.delete(base, base.where("o_custkey % 3 = 0"), "o_orderkey")


def _event_ops(spark, sf_dir):
    op = "CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'drop' ELSE 'put' END"
    return table(spark, sf_dir, "events").select(
        F.expr(op).alias("op"),
        F.concat(F.lit("c"), F.col("user_id") % 5).alias("collection"),
        F.col("user_id").alias("id"),
        F.col("props").alias("doc"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("t"), F.floor(F.col("event_id") / 8)).alias("tx"),
        F.expr("event_id % 8").alias("nth"),
        F.expr("pmod(floor(event_id / 8), 3)").alias("fate"),
    )


_EVENT_OPS = """
    SELECT CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'drop' ELSE 'put' END AS op,
           'c' || (user_id % 5) AS collection, user_id AS id, props AS doc, event_id AS seq,
           event_id // 8 AS tx, event_id % 8 AS nth, (event_id // 8) % 3 AS fate
    FROM events
"""


@_query(f"""
    WITH ops AS ({_EVENT_OPS}), drops AS (SELECT collection, max(seq) AS dropped FROM ops WHERE op = 'drop' GROUP BY 1),
    last AS (SELECT collection, id, doc, op, seq FROM ops WHERE op <> 'drop'
             QUALIFY row_number() OVER (PARTITION BY collection, id ORDER BY seq DESC) = 1)
    SELECT last.collection, id, doc FROM last LEFT JOIN drops USING (collection)
    WHERE op = 'put' AND (dropped IS NULL OR seq > dropped)
""")
def replay_last_write_wins(spark, sf_dir):
    return replay.live(_event_ops(spark, sf_dir), ["seq"])


@_query(f"""
    WITH ops AS ({_EVENT_OPS} QUALIFY true),
    done AS (SELECT * FROM ops WHERE nth BETWEEN 1 AND 6 AND fate <> 1
             AND tx IN (SELECT tx FROM ops WHERE nth = 0) AND tx IN (SELECT tx FROM ops WHERE nth = 7)),
    drops AS (SELECT collection, max(seq) AS dropped FROM done WHERE op = 'drop' GROUP BY 1),
    last AS (SELECT collection, id, doc, op, seq FROM done WHERE op <> 'drop'
             QUALIFY row_number() OVER (PARTITION BY collection, id ORDER BY seq DESC) = 1)
    SELECT last.collection, id, doc FROM last LEFT JOIN drops USING (collection)
    WHERE op = 'put' AND (dropped IS NULL OR seq > dropped)
""".replace(" QUALIFY true", ""))
def replay_committed_only(spark, sf_dir):
    frames = _event_ops(spark, sf_dir).withColumn(
        "type", F.expr("CASE WHEN nth = 0 THEN 'begin' WHEN nth = 7 AND fate <> 1 THEN 'commit' ELSE 'operation' END")
    )
    return replay.live(replay.committed(frames))


@_query("SELECT o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1")
def index_sizes(spark, sf_dir):
    return index.index_sizes(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice < 50000")
def index_lookup_with_rest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    found = index.lookup(rows, index.build_index(rows, "o_orderpriority", "o_orderkey"), "2-HIGH", "o_orderkey")
    return Query(found).where("o_totalprice", "<", 50000).select("o_orderkey", "o_totalprice").find()


@_query("""
    SELECT lower(trim(' Events ')) || ':' || 'user_id=' || user_id AS query, count(*) AS hits
    FROM events GROUP BY 1 HAVING count(*) >= 3
""")
def hot_lookups(spark, sf_dir):
    query = index.normal_query(F.lit(" Events "), F.lit("user_id"), F.col("user_id").cast("string"))
    return index.hot_queries(table(spark, sf_dir, "events").withColumn("query", query), "query")


@_query("""
    SELECT p_partkey, list_reduce(list_prepend(2166136261::HUGEINT,
        list_transform(range(1, strlen(p_name) + 1), lambda i: ascii(p_name[i])::HUGEINT)),
        lambda h, b: (xor(h::BIGINT, b::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT AS h
    FROM part
""")
def fnv1a_of_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashes.fnv1a32(F.col("p_name")).alias("h"))


# the table-free form: each byte, then eight steps (marked -1) over its bits
@_query("""
    SELECT p_partkey, xor(list_reduce(list_prepend(4294967295::BIGINT,
        flatten(list_transform(range(1, strlen(p_name) + 1), lambda i: [ascii(p_name[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END),
        4294967295::BIGINT)::BIGINT AS crc
    FROM part
""")
def crc32_of_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashes.crc32(F.col("p_name")).alias("crc"))


@_query("""
    SELECT event_id, CASE WHEN event_type ~ 'index|drop|make' THEN 'admin'
        WHEN event_type ~ 'insert|put|update|delete|del|write|save|commit' THEN 'write'
        WHEN event_type ~ 'flush|stats|backup|close|vacuum|checkpoint' THEN 'maintenance'
        WHEN event_type ~ 'query|find|count|scan|where' THEN 'query' ELSE 'read' END AS kind,
      'db|read|' || event_type || '|events|kind==&user_id==|rows' AS signature
    FROM events
""")
def operation_signatures(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    tests = F.array(F.lit("user_id=="), F.lit("kind=="))
    return rows.select(
        "event_id",
        scoring.kind_of(F.col("event_type")).alias("kind"),
        scoring.signature(F.lit("db"), F.lit("read"), F.col("event_type"), F.lit("events"), tests, F.lit(False)).alias("signature"),
    )


_SEMANTIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN {s}" for p, s in scoring.SEMANTIC) + f" ELSE {scoring.OTHER_SEMANTIC} END"


@_query(f"SELECT doc_id, {_SEMANTIC_SQL}::DOUBLE AS semantic FROM (SELECT doc_id, source || ' ' || lang || ' ' || text AS t FROM documents)")
def semantic_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", scoring.semantic(F.col("source"), F.col("lang"), F.col("text")).alias("semantic"))


@_query("""
    SELECT user_id, round(10000 / (1 + exp(-(-0.2 + 1.5 * 0.5 + 0.9 * 0.7 + 0.6 * 0.45
        + 0.4 * least(1, ln(1 + hits) / ln(64)) + 0.18 * least(1, ms / 250) - 0.08))))::BIGINT AS score,
        round(least(1, 0.2 + hits / 12 + 5 / 40), 6) AS confidence
    FROM (SELECT user_id, count(*) AS hits, avg(value) AS ms FROM events GROUP BY 1)
""")
def importance_scores(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("hits"), F.avg("value").alias("ms"))
    score = scoring.importance(
        F.lit(5.0), F.lit(7.0), F.lit(scoring.OTHER_SEMANTIC), F.col("hits"), F.col("ms"), F.lit("query"), F.lit(True)
    )
    return sums.select("user_id", score.alias("score"), F.round(scoring.confidence(F.col("hits"), F.lit(5.0)), 6).alias("confidence"))


@_query("""
    WITH s AS (SELECT event_type AS database, user_id, count(*) AS hits FROM events GROUP BY 1, 2)
    SELECT database, (500 + round(10 * sum(least(1, ln(1 + hits) / ln(32)))))::DOUBLE AS score, sum(hits)::BIGINT AS queries
    FROM s GROUP BY 1
""")
def database_ranks(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("database"), F.col("user_id").cast("string").alias("signature"))
    return scoring.database_rank(log, log.select("database", F.lit(5.0).alias("priority")).distinct())


@_query("""
    SELECT user_id, round(list_reduce(list(value ORDER BY event_id),
        lambda old, x: CASE WHEN old = 0 THEN x ELSE old * 0.75 + x * 0.25 END), 6) AS ewma
    FROM events GROUP BY 1
""")
def latency_ewma(spark, sf_dir):
    found = scoring.ewma(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return found.select("user_id", F.round("ewma", 6).alias("ewma"))


@_query("SELECT event_id, props FROM events")
def sealed_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    old, new = (sealed.derive_key("a password of some length", salt) for salt in (b"0" * 16, b"1" * 16))
    closed = sealed.rotate(sealed.seal(rows, ["props"], old, "events"), ["props"], old, new, "events")
    return sealed.unseal(closed, ["props"], new, "events")


@_query("SELECT o_orderkey, o_orderstatus IS DISTINCT FROM 'F' AS other, o_totalprice < 1000 AS cheap FROM orders")
def projected_conditions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        "o_orderkey",
        predicate(rows.schema, "o_orderstatus", "!=", "F", projected=True).alias("other"),
        predicate(rows.schema, "o_totalprice", "<", 1000, projected=True).alias("cheap"),
    )


@_query(f"SELECT collection, count(*) AS live FROM ({ORACLE_SQL['replay_last_write_wins']}) GROUP BY 1")
def live_counts(spark, sf_dir):
    found = replay.live(_event_ops(spark, sf_dir), ["seq"])
    return found.groupBy("collection").agg(F.count("*").alias("live"))


