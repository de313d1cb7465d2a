"""The registered queries of the engine's own operators, each with its DuckDB SQL.

Every query takes (spark, directory of Parquet tables) and runs over whole
tables; a limit stands only where it is the operator itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import convert
from .functions.compare import compare_values
from .functions.keys import little_endian_hex, pack_column_key, unpack_column_key
from .functions.text import tokenise
from .operators import bulk, dml, index, links, schema, versioning, wal
from .operators.query import Query, RowIterator, chunk_rows, chunk_stats, ends, members_of, select, slice_rows, where_key
from .plans.cache import PlanCache, estimated_cardinality, newest, node_cost, rollup
from .plans.predicate import complexity, parse
from .sources import storage
from .sources.catalog import Catalog, current_metadata, put_metadata, remove_metadata
from .sources.spec import ColumnSpec, TableSpec, clear_attribute, has_attribute, set_attribute, violations
from .streaming import files
from .streaming.results import Cancel, Interrupted, QueryManager, ResultStream, process, run_interruptibly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of a catalog under its name."""

    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def predicate(name: str, table: str, text: str, columns: str, where: str, nulls: str = "sql") -> None:
    """Register a predicate in text form over a table, and the same condition in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = Catalog(spark, sf_dir)
        return Query(catalog.table(table), catalog.key(table), nulls).where(text).matches().select(*columns.split(", "))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {columns} FROM {table} WHERE {where}"


# Filters. lineitem has no unique key; its predicates don't need one.
predicate("p_eq", "customer", "c_mktsegment = 'BUILDING'", "c_custkey, c_name", "c_mktsegment = 'BUILDING'")
predicate("p_ne", "customer", "c_mktsegment != 'BUILDING'", "c_custkey, c_mktsegment", "c_mktsegment <> 'BUILDING'")
predicate("p_lt", "orders", "o_totalprice < 50000", "o_orderkey, o_totalprice", "o_totalprice < 50000")
predicate("p_le", "part", "p_size <= 10", "p_partkey, p_size", "p_size <= 10")
predicate("p_gt", "orders", "o_totalprice > 400000.5", "o_orderkey, o_totalprice", "o_totalprice > 400000.5")
predicate("p_ge", "part", "p_size >= 40", "p_partkey, p_size", "p_size >= 40")
predicate("p_contains", "part", "p_name CONTAINS 'ring'", "p_partkey, p_name", "contains(p_name, 'ring')")
predicate("p_beginswith", "part", "p_brand BEGINSWITH 'Brand#1'", "p_partkey, p_brand", "starts_with(p_brand, 'Brand#1')")
predicate("p_endswith", "part", 'p_type ENDSWITH "LL"', "p_partkey, p_type", "ends_with(p_type, 'LL')")
predicate("p_like", "customer", "c_name LIKE '%00_1%'", "c_custkey, c_name", "c_name LIKE '%00_1%'")
predicate("p_in", "events", "event_type IN ('click', 'view')", "event_id, event_type", "event_type IN ('click', 'view')")
predicate("p_between", "part", "p_size BETWEEN 10 AND 20", "p_partkey, p_size", "p_size BETWEEN 10 AND 20")
predicate(
    "p_and", "orders", "o_orderstatus = 'F' AND o_totalprice > 200000", "o_orderkey, o_orderstatus, o_totalprice",
    "o_orderstatus = 'F' AND o_totalprice > 200000",
)
predicate("p_or", "orders", "o_orderstatus = 'P' OR o_totalprice > 450000", "o_orderkey, o_orderstatus", "o_orderstatus = 'P' OR o_totalprice > 450000")
predicate("p_not", "orders", "NOT o_orderstatus = 'F'", "o_orderkey, o_orderstatus", "NOT o_orderstatus = 'F'")
predicate(
    "p_nested", "part", "(p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#11' OR p_name CONTAINS 'a')", "p_partkey, p_size, p_brand",
    "(p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#11' OR contains(p_name, 'a'))",
)
predicate("p_literal_left", "orders", "400000 < o_totalprice", "o_orderkey, o_totalprice", "400000 < o_totalprice")
predicate("p_negative", "customer", "c_acctbal < -100", "c_custkey, c_acctbal", "c_acctbal < -100")
predicate(
    "p_timestamp", "orders", "o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'", "o_orderkey, o_orderdate",
    "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
)
predicate(
    "p_nocase_ascii", "documents", "text CONTAINS[c] 'THE AND'", "doc_id",
    "contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the and')",
)
predicate("p_multi_needle", "part", "p_size = 1 OR p_size = 7 OR 9 = p_size OR p_size = 49", "p_partkey, p_size", "p_size IN (1, 7, 9, 49)")
predicate("p_double_negation", "part", "NOT NOT p_size NOT BETWEEN 3 AND 48", "p_partkey, p_size", "NOT (p_size BETWEEN 3 AND 48)")


def _labelled(c: Catalog) -> DataFrame:
    labels = c.table("labels").select(F.col("doc_id").alias("l_doc"), "quality", "toxic")
    docs = c.table("documents").select("doc_id", "n_chars")
    return docs.join(labels, F.col("doc_id") == F.col("l_doc"), "left").withColumn("is_toxic", F.col("toxic") == 1)


_LABELLED = "(SELECT d.doc_id, d.n_chars, l.quality, l.toxic, l.toxic = 1 AS is_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"SELECT doc_id FROM {_LABELLED} WHERE quality = 1")
def p_null_sql(c: Catalog) -> DataFrame:
    return Query(_labelled(c), "doc_id").where("quality = 1").matches().select("doc_id")


@query(f"SELECT doc_id FROM {_LABELLED} WHERE coalesce(quality = 1, true)")
def p_null_legacy(c: Catalog) -> DataFrame:
    return Query(_labelled(c), "doc_id", "legacy").where("quality = 1").matches().select("doc_id")


@query(f"SELECT doc_id FROM {_LABELLED} WHERE NOT coalesce(quality = 0, true) AND coalesce(toxic <= 0, true)")
def p_null_legacy_not(c: Catalog) -> DataFrame:
    return Query(_labelled(c), "doc_id", "legacy").where("NOT quality = 0 AND toxic <= 0").matches().select("doc_id")


@query(f"SELECT doc_id FROM {_LABELLED} WHERE coalesce(is_toxic, false) AND n_chars > 500")
def p_bool_property(c: Catalog) -> DataFrame:
    return Query(_labelled(c), "doc_id").where("is_toxic AND n_chars > 500").matches().select("doc_id")


@query(f"SELECT doc_id FROM {_LABELLED} WHERE quality IS NULL")
def p_is_null(c: Catalog) -> DataFrame:
    return Query(_labelled(c), "doc_id").where("quality = NULL").matches().select("doc_id")


# Results.
def _orders(c: Catalog) -> Query:
    return Query(c.table("orders"), "o_orderkey")


_ORDER = "o_orderkey, o_custkey, o_totalprice"
_ORDERS = _ORDER.split(", ")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def r_find_all(c: Catalog) -> DataFrame:
    return _orders(c).where("o_orderpriority = '1-URGENT'").find_all().df.select(*_ORDERS)


@query(f"SELECT {_ORDER} FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 1")
def r_find_first(c: Catalog) -> DataFrame:
    return _orders(c).where("o_totalprice > 300000").find_first().select(*_ORDERS)


@query(f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25")
def r_limit(c: Catalog) -> DataFrame:
    return _orders(c).where("o_orderstatus = 'O'").limit(25).frame().select(*_ORDERS)


@query(
    f"SELECT doc_id, quality, n_chars FROM {_LABELLED} ORDER BY quality ASC NULLS FIRST, n_chars DESC NULLS LAST, doc_id LIMIT 50"
)
def r_sort_multi(c: Catalog) -> DataFrame:
    return Query(_labelled(c), "doc_id").sort(("quality", True), ("n_chars", False)).top_k(50).select("doc_id", "quality", "n_chars")


@query(f"SELECT {_ORDER} FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 40) ORDER BY o_totalprice DESC")
def r_limit_then_sort(c: Catalog) -> DataFrame:
    return _orders(c).where("o_orderstatus = 'F'").limit(40).sort(("o_totalprice", False)).frame().select(*_ORDERS)


@query(f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40")
def r_top_k(c: Catalog) -> DataFrame:
    return _orders(c).where("o_orderstatus = 'F'").sort(("o_totalprice", False)).top_k(40).select(*_ORDERS)


@query("SELECT count(*) AS n FROM lineitem")
def r_count(c: Catalog) -> DataFrame:
    return Query(c.table("lineitem"), "l_orderkey").count()


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 30 AND l_returnflag <> 'N' AND l_discount < 0.05")
def r_count_filtered(c: Catalog) -> DataFrame:
    return Query(c.table("lineitem"), "l_orderkey").where("l_quantity >= 30 AND l_returnflag != 'N' AND l_discount < 0.05").count()


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 20 OFFSET 10")
def r_offset_select(c: Catalog) -> DataFrame:
    return select(c.table("customer"), ["c_custkey", "c_name"], {"c_mktsegment": "MACHINERY"}, "c_custkey", 20, 10)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 30 OFFSET 45")
def r_slice(c: Catalog) -> DataFrame:
    return slice_rows(c.table("part").select("p_partkey", "p_name"), "p_partkey", 45, 75)


@query("SELECT min(event_id) AS first_id, max(event_id) AS last_id FROM events")
def r_first_last(c: Catalog) -> DataFrame:
    return ends(c.table("events"), "event_id").select(F.col("first_key").alias("first_id"), F.col("last_key").alias("last_id"))


@query(
    "SELECT (rn // 1000)::BIGINT AS chunk_id, count(*) AS n, min(event_id) AS min_key, max(event_id) AS max_key "
    "FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) GROUP BY 1"
)
def r_chunk_stats(c: Catalog) -> DataFrame:
    return chunk_stats(c.table("events"), "event_id", 1000)


@query(f"SELECT {_ORDER} FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500) WHERE o_totalprice > 250000")
def r_query_on_view(c: Catalog) -> DataFrame:
    view = _orders(c).where("o_orderstatus = 'F'").limit(500).find_all()
    return view.query().where("o_totalprice > 250000").frame().select(*_ORDERS)


@query(f"SELECT {_ORDER} FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 7")
def r_view_key_at(c: Catalog) -> DataFrame:
    return _orders(c).where("o_orderstatus = 'P'").sort("o_totalprice").find_all().objects_at(7).select(*_ORDERS)


# Bulk comparisons and indexes.
@query(
    "SELECT unnest(['=', '!=', '<', '<=', '>', '>=']) AS op, unnest([count(*) FILTER (p_size = 15), count(*) FILTER (p_size <> 15), "
    "count(*) FILTER (p_size < 15), count(*) FILTER (p_size <= 15), count(*) FILTER (p_size > 15), count(*) FILTER (p_size >= 15)]) AS matches FROM part"
)
def v_int_mask_counts(c: Catalog) -> DataFrame:
    return bulk.match_counts(c.table("part"), "p_size", [(op, 15) for op in ("=", "!=", "<", "<=", ">", ">=")])


@query(
    "SELECT unnest(['=', 'CONTAINS', 'BEGINSWITH', 'ENDSWITH']) AS op, unnest([count(*) FILTER (lower(p_brand) = 'brand#13'), "
    "count(*) FILTER (contains(lower(p_brand), '#1')), count(*) FILTER (starts_with(lower(p_brand), 'brand#2')), "
    "count(*) FILTER (ends_with(lower(p_brand), '3'))]) AS matches FROM part"
)
def v_string_mask_counts(c: Catalog) -> DataFrame:
    tests = [("=", "BRAND#13"), ("CONTAINS", "#1"), ("BEGINSWITH", "bRAND#2"), ("ENDSWITH", "3")]
    return bulk.match_counts(c.table("part"), "p_brand", tests, case_sensitive=False)


@query("SELECT p_partkey FROM part WHERE p_partkey >= 100 AND p_partkey < 900 AND p_size >= 25")
def v_find_positions(c: Catalog) -> DataFrame:
    return bulk.find_positions(c.table("part"), "p_partkey", "p_size", ">=", 25, 100, 900)


@query("SELECT doc_id, list_transform(string_split(source, 'c'), lambda x: x >= '1') AS mask FROM documents")
def v_array_mask(c: Catalog) -> DataFrame:
    return c.table("documents").select("doc_id", bulk.array_mask(F.split("source", "c"), ">=", "1").alias("mask"))


@query("SELECT count(*) AS n FROM part WHERE p_brand = 'Brand#13'")
def x_exact_count(c: Catalog) -> DataFrame:
    return index.count(index.postings(c.table("part"), "p_partkey", "p_brand"), "Brand#13")


@query("SELECT p_partkey AS key FROM part WHERE starts_with(p_name, 'b')")
def x_prefix(c: Catalog) -> DataFrame:
    return index.find_prefix(index.postings(c.table("part"), "p_partkey", "p_name"), "b")


_TOKENS = (
    "list_distinct(list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^a-zA-Z0-9]+'), lambda x: x <> ''))"
)


@query(f"SELECT doc_id, len({_TOKENS.format('text')})::BIGINT AS n_tokens FROM documents")
def x_fulltext_tokens(c: Catalog) -> DataFrame:
    return c.table("documents").select("doc_id", F.size(tokenise(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id FROM documents WHERE len(list_intersect({_TOKENS.format('text')}, ['the', 'thonon'])) = 2")
def x_fulltext_search(c: Catalog) -> DataFrame:
    return index.search(c.table("documents"), "doc_id", "text", ["The", "thonon"])


@query(
    f"SELECT token, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM (SELECT unnest({_TOKENS.format('text')}) AS token, "
    "doc_id AS key FROM documents) GROUP BY token"
)
def x_inverted_index(c: Catalog) -> DataFrame:
    return index.document_frequencies(c.table("documents"), "doc_id", "text")


@query("SELECT l_linenumber::VARCHAR AS value, l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def x_verify_duplicates(c: Catalog) -> DataFrame:
    return index.duplicates(index.postings(c.table("lineitem"), "l_orderkey", "l_linenumber"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 299")
def x_range(c: Catalog) -> DataFrame:
    return index.key_range(c.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 299)


_RANGES = [(10, 40), (30, 60), (500, 520)]


@query(
    "SELECT o_orderkey, r.range_id FROM orders JOIN (VALUES (0, 10, 40), (1, 30, 60), (2, 500, 520)) r(range_id, a, b) ON o_orderkey BETWEEN r.a AND r.b"
)
def x_multi_range(c: Catalog) -> DataFrame:
    return index.multi_range(c.table("orders").select("o_orderkey"), "o_orderkey", _RANGES)


@query(
    "SELECT o_orderkey, e.event_id FROM orders JOIN (SELECT event_id, event_id * 3 AS a, event_id * 3 + 4 AS b FROM events) e ON o_orderkey BETWEEN e.a AND e.b"
)
def x_range_join(c: Catalog) -> DataFrame:
    ranges = c.table("events").select("event_id", (F.col("event_id") * 3).alias("start"), (F.col("event_id") * 3 + 4).alias("end"))
    return index.range_join(c.table("orders").select("o_orderkey"), "o_orderkey", ranges, 8).select("o_orderkey", "event_id")


@query("SELECT event_id FROM events WHERE event_id >= 123 ORDER BY event_id LIMIT 1")
def x_seek(c: Catalog) -> DataFrame:
    return index.seek(c.table("events").select("event_id"), "event_id", 123)


@query(
    "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey) OVER w AS next_key FROM orders "
    "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"
)
def x_seek_next(c: Catalog) -> DataFrame:
    return index.neighbours(c.table("orders"), "o_orderkey", "o_custkey")


@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def x_last_write_wins(c: Catalog) -> DataFrame:
    events = c.table("events")
    top = events.select("user_id").distinct().withColumns({"value": F.lit(-1.0), "event_id": F.lit(-1).cast("long")})
    latest = versioning.as_of(events, "user_id", "event_id", 1 << 62, ["value"])
    return dml.upsert(top, latest.select("user_id", "value", "event_id"), "user_id")


# Links.
@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def k_follow(c: Catalog) -> DataFrame:
    return links.follow(c.table("orders"), "o_custkey", c.table("customer"), "c_custkey", ["c_name"]).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def k_two_hop(c: Catalog) -> DataFrame:
    once = links.follow(c.table("orders"), "o_custkey", c.table("customer"), "c_custkey", ["c_nationkey"])
    return links.follow(once, "c_nationkey", c.table("nation"), "n_nationkey", ["n_name"]).select("o_orderkey", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_links FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def k_backlinks(c: Catalog) -> DataFrame:
    return links.backlink_counts(c.table("customer"), "c_custkey", c.table("orders"), "o_custkey")


@query("SELECT o_custkey AS target, list(o_orderkey ORDER BY o_orderkey) AS origins, count(*) AS n FROM orders GROUP BY 1")
def k_backlink_lists(c: Catalog) -> DataFrame:
    return links.backlink_lists(c.table("orders"), "o_custkey", "o_orderkey")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def k_dangling(c: Catalog) -> DataFrame:
    return links.dangling(c.table("documents").select("doc_id", "source"), "doc_id", c.table("labels"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def k_exists(c: Catalog) -> DataFrame:
    return links.existing(c.table("documents").select("doc_id", "source"), "doc_id", c.table("labels"), "doc_id")


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (SELECT c_name FROM customer WHERE c_custkey = user_id) "
    "WHEN event_id % 3 = 1 THEN (SELECT s_name FROM supplier WHERE s_suppkey = user_id) END AS target_value FROM events"
)
def k_typed_link(c: Catalog) -> DataFrame:
    table = F.when(F.col("event_id") % 3 == 0, "customer").when(F.col("event_id") % 3 == 1, "supplier")
    events = c.table("events").select("event_id", "user_id", table.alias("table"))
    targets = {"customer": (c.table("customer"), "c_custkey", "c_name"), "supplier": (c.table("supplier"), "s_suppkey", "s_name")}
    return links.follow_typed(events, "table", "user_id", targets).select("event_id", "target_value")


@query(
    "SELECT target, list_contains(o, 7) AS has_7, len(o)::BIGINT AS n FROM (SELECT o_custkey AS target, list(o_orderkey % 10) AS o FROM orders GROUP BY 1)"
)
def k_linkset_contains(c: Catalog) -> DataFrame:
    sets = links.backlink_lists(c.table("orders").withColumn("k", F.col("o_orderkey") % 10), "o_custkey", "k")
    return sets.select("target", links.set_contains(F.col("origins"), F.lit(7)).alias("has_7"), links.set_size(F.col("origins")).cast("long").alias("n"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def k_embedded_explode(c: Catalog) -> DataFrame:
    nested = links.embed(c.table("customer").select("c_custkey"), "c_custkey", c.table("orders"), "o_custkey", ["o_orderkey", "o_totalprice"], "orders")
    return links.unnest(nested, "orders")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def k_cascade_delete(c: Catalog) -> DataFrame:
    gone = Query(c.table("customer"), "c_custkey").where("c_acctbal < 0").matches()
    return links.cascade_delete(c.table("orders"), "o_custkey", gone, "c_custkey").select("o_orderkey")


# Schemas and changes.
_OLD = [
    {"object": "User", "property": "id", "type": "int", "is_primary": True}, {"object": "User", "property": "name", "type": "string"},
    {"object": "User", "property": "age", "type": "string", "is_nullable": True}, {"object": "User", "property": "old", "type": "bool"},
    {"object": "Gone", "property": "id", "type": "int", "is_primary": True},
]
_NEW = [
    {"object": "User", "property": "id", "type": "int"}, {"object": "User", "property": "name", "type": "string", "is_indexed": True, "is_primary": True},
    {"object": "User", "property": "age", "type": "int"}, {"object": "User", "property": "email", "type": "string", "is_nullable": True},
    {"object": "Product", "property": "id", "type": "int", "is_primary": True}, {"object": "Product", "property": "owner", "type": "link", "object_type": "Nobody"},
    {"object": "Product", "property": "bad", "type": "link", "is_nullable": True},
]


@query(
    "SELECT * FROM (VALUES ('Gone', '', 'RemoveTable'), ('Product', '', 'AddTable'), ('Product', '', 'AddInitialProperties'), "
    "('User', 'name', 'ChangePrimaryKey'), ('User', 'name', 'AddIndex'), ('User', 'age', 'ChangePropertyType'), "
    "('User', 'age', 'MakePropertyRequired'), ('User', 'old', 'RemoveProperty'), ('User', 'email', 'AddProperty')) t(object, property, change)"
)
def g_diff(c: Catalog) -> DataFrame:
    return schema.diff(schema.properties(c.spark, _OLD), schema.properties(c.spark, _NEW))


@query(
    "SELECT * FROM (VALUES ('Product', 'bad', 'link has no object type'), ('Product', 'owner', 'link target is missing')) t(object, property, problem)"
)
def g_validate(c: Catalog) -> DataFrame:
    return schema.validate(schema.properties(c.spark, _NEW))


@query("SELECT p_partkey, p_size::BIGINT AS p_size, NULL::BIGINT AS stock, coalesce(p_name, '') AS p_name FROM part")
def g_apply(c: Catalog) -> DataFrame:
    changes = [
        {"object": "part", "property": "p_size", "change": "ChangePropertyType"}, {"object": "part", "property": "stock", "change": "AddProperty"},
        {"object": "part", "property": "p_brand", "change": "RemoveProperty"}, {"object": "part", "property": "p_name", "change": "MakePropertyRequired"},
    ]
    part = c.table("part").select("p_partkey", "p_name", "p_size", "p_brand")
    done = schema.apply(part, "part", changes, {"p_size": "int", "stock": "int", "p_name": "string"})
    return done.select("p_partkey", "p_size", "stock", "p_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def m_update(c: Catalog) -> DataFrame:
    return dml.update(c.table("customer").select("c_custkey", "c_acctbal"), {"c_acctbal": 0.0}, F.col("c_acctbal") < 0)


@query("SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING')")
def m_delete(c: Catalog) -> DataFrame:
    return dml.delete(c.table("customer").select("c_custkey", "c_mktsegment"), F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def m_delete_keys(c: Catalog) -> DataFrame:
    gone = c.table("lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return dml.delete_keys(c.table("orders").select("o_orderkey"), gone, "o_orderkey")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT max(r_regionkey) + 1, 'NEW' FROM region")
def m_insert(c: Catalog) -> DataFrame:
    return dml.insert(c.table("region"), {"r_name": "NEW"}, key="r_regionkey")


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS note FROM nation")
def m_add_column(c: Catalog) -> DataFrame:
    return dml.add_column(c.table("nation"), ColumnSpec("note", "string", nullable=True)).select("n_nationkey", "n_name", "note")


@query("SELECT n_nationkey, n_regionkey FROM nation")
def m_drop_column(c: Catalog) -> DataFrame:
    return dml.drop_column(c.table("nation"), "n_name")


# Versions and log.
@query(
    "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id <= 5000 GROUP BY user_id"
)
def n_asof(c: Catalog) -> DataFrame:
    return versioning.as_of(c.table("events"), "user_id", "event_id", 5000, ["value"])


@query("SELECT event_id FROM events WHERE event_id <= 700")
def n_visible_rr(c: Catalog) -> DataFrame:
    rule = versioning.visible(F.col("event_id"), F.col("ts"), "repeatable_read", 700, F.lit(None))
    return c.table("events").where(rule).select("event_id")


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-05 00:00:00'")
def n_visible_rc(c: Catalog) -> DataFrame:
    at = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return c.table("events").where(versioning.visible(F.col("event_id"), F.col("ts"), "read_committed", 0, at)).select("event_id")


@query(
    "SELECT event_id FROM events LEFT JOIN (SELECT user_id AS u, max(event_id) AS base FROM events WHERE event_id <= 4000 GROUP BY 1) ON u = user_id "
    "WHERE event_id > 4000 OR event_id = base"
)
def n_gc(c: Catalog) -> DataFrame:
    return versioning.retained(c.table("events"), "user_id", "event_id", 4000).select("event_id")


def _log(c: Catalog) -> DataFrame:
    """A log made of the events: each user's first is a beginning, the last of some a commit or a rollback."""
    ends = c.table("events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    last_type = F.when(F.col("user_id") % 3 == 0, "COMMIT").when(F.col("user_id") % 3 == 1, "ROLLBACK").otherwise("OP")
    kind = F.when(F.col("event_id") == F.col("a"), "BEGIN").when(F.col("event_id") == F.col("b"), last_type).otherwise("OP")
    return c.table("events").join(ends, "user_id").select(
        F.col("event_id").alias("pos"), kind.alias("type"), F.col("user_id").alias("txn"), F.col("event_id").alias("version"), "ts", F.col("event_type").alias("data"),
    )


_LOG = (
    "(SELECT event_id AS pos, CASE WHEN event_id = a THEN 'BEGIN' WHEN event_id = b THEN CASE user_id % 3 WHEN 0 THEN 'COMMIT' WHEN 1 THEN 'ROLLBACK' "
    "ELSE 'OP' END ELSE 'OP' END AS type, user_id AS txn, event_id AS version, event_type AS data FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) "
    "AS a, max(event_id) OVER (PARTITION BY user_id) AS b FROM events))"
)
_TXNS = (
    f"(SELECT txn, CASE WHEN NOT bool_or(type = 'BEGIN') THEN 'unknown' WHEN bool_or(type = 'COMMIT') THEN 'committed' WHEN bool_or(type = 'ROLLBACK') "
    f"THEN 'rolled_back' ELSE 'pending' END AS state, count(*) FILTER (type = 'OP') AS ops, max(version) FILTER (type = 'COMMIT') AS version FROM {_LOG} GROUP BY txn)"
)


@query(f"SELECT txn, state, ops, version FROM {_TXNS}")
def w_replay(c: Catalog) -> DataFrame:
    return wal.transactions(_log(c))


@query(f"SELECT txn, ops FROM {_TXNS} WHERE state = 'pending'")
def w_pending(c: Catalog) -> DataFrame:
    return wal.pending(_log(c))


@query(f"SELECT arg_max(version, pos) AS version FROM {_LOG} WHERE type = 'COMMIT'")
def w_last_committed(c: Catalog) -> DataFrame:
    return wal.last_committed(_log(c))


@query(f"SELECT pos, txn FROM {_LOG} WHERE pos > (SELECT max(event_id) FROM events WHERE event_id % 1000 = 0)")
def w_compact(c: Catalog) -> DataFrame:
    marked = _log(c).withColumn("type", F.when(F.col("pos") % 1000 == 0, "CHECKPOINT").otherwise(F.col("type")))
    return wal.compact(marked).select("pos", "txn")


@query("SELECT event_id, list_reduce(list_transform(string_split(event_type, ''), lambda x: ascii(x)), lambda a, b: xor(a, b))::INTEGER AS checksum FROM events")
def w_checksum(c: Catalog) -> DataFrame:
    return c.table("events").select("event_id", wal.xor_bytes(F.col("event_type")).alias("checksum"))


@query(f"SELECT type, count(*) AS entries, sum(length(data))::BIGINT AS bytes, min(pos) AS first_pos, max(pos) AS last_pos FROM {_LOG} GROUP BY type")
def w_statistics(c: Catalog) -> DataFrame:
    return wal.statistics(_log(c))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def p_member_table(c: Catalog) -> DataFrame:
    needles = c.table("part").where("p_size < 5").select("p_partkey")
    return members_of(c.table("lineitem"), "l_partkey", needles).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "SELECT doc_id, CASE WHEN quality IS NULL THEN CASE WHEN toxic IS NULL THEN 0 ELSE -1 END WHEN toxic IS NULL THEN 1 WHEN quality < toxic THEN -1 "
    f"WHEN quality > toxic THEN 1 ELSE 0 END AS c FROM {_LABELLED}"
)
def p_compare_nulls_first(c: Catalog) -> DataFrame:
    kind = T.IntegerType()
    return _labelled(c).select("doc_id", compare_values(F.col("quality"), kind, F.col("toxic"), kind, "int").alias("c"))


# Conversions.
def _texts() -> Column:
    values = F.array(*[F.lit(x) for x in ["12", "-7", "2.5", "abc", "true", "F", " 3", "1e3", "0", ""]])
    return F.element_at(values, (F.col("event_id") % 10 + 1).cast("int"))


_TEXT_SQL = "list_extract(['12', '-7', '2.5', 'abc', 'true', 'F', ' 3', '1e3', '0', ''], (event_id % 10 + 1)::INTEGER)"
_TEXT = T.StringType()


@query(
    f"SELECT event_id, CASE WHEN regexp_full_match({_TEXT_SQL}, '[+-]?[0-9]+') THEN try_cast({_TEXT_SQL} AS BIGINT) END AS from_text, "
    "trunc(value)::BIGINT AS from_double FROM events"
)
def c_to_int(c: Catalog) -> DataFrame:
    return c.table("events").select("event_id", convert.to_int(_texts(), _TEXT).alias("from_text"), convert.to_int(F.col("value"), T.DoubleType()).alias("from_double"))


_NUMBER_SQL = f"CASE WHEN regexp_full_match({_TEXT_SQL}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({_TEXT_SQL} AS DOUBLE) END"


@query(
    f"SELECT event_id, CASE WHEN {_TEXT_SQL} IN ('1','t','T','TRUE','true','True') THEN true WHEN {_TEXT_SQL} IN ('0','f','F','FALSE','false','False') "
    f"THEN false ELSE {_NUMBER_SQL} <> 0 END AS from_text, event_id % 4 <> 0 AS from_int FROM events"
)
def c_to_bool(c: Catalog) -> DataFrame:
    return c.table("events").select("event_id", convert.to_bool(_texts(), _TEXT).alias("from_text"), convert.to_bool(F.col("event_id") % 4, T.LongType()).alias("from_int"))


@query(
    "SELECT event_id, event_id::VARCHAR AS from_int, (event_id % 2 = 0)::VARCHAR AS from_bool, ((event_id % 1000) / 8)::DOUBLE::VARCHAR AS from_float, "
    "CASE WHEN event_id % 5 > 0 THEN (event_id % 5)::VARCHAR END AS from_null FROM events"
)
def c_to_string(c: Catalog) -> DataFrame:
    some = F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 5)
    return c.table("events").select(
        "event_id", convert.to_text(F.col("event_id")).alias("from_int"), convert.to_text(F.col("event_id") % 2 == 0).alias("from_bool"),
        convert.to_text((F.col("event_id") % 1000) / F.lit(8.0)).alias("from_float"), convert.to_text(some).alias("from_null"),
    )


@query(f"SELECT event_id, ({_NUMBER_SQL})::FLOAT AS from_text, (event_id / 3)::FLOAT AS from_double, (event_id % 2)::FLOAT AS from_bool FROM events")
def c_to_float(c: Catalog) -> DataFrame:
    return c.table("events").select(
        "event_id", convert.to_double(_texts(), _TEXT, single=True).alias("from_text"),
        convert.to_double(F.col("event_id") / F.lit(3.0), T.DoubleType(), single=True).alias("from_double"), convert.to_double(F.col("event_id") % 2 == 1, T.BooleanType(), single=True).alias("from_bool"),
    )


@query(f"SELECT event_id, {_NUMBER_SQL} AS from_text, (event_id % 2)::DOUBLE AS from_bool FROM events")
def c_to_double(c: Catalog) -> DataFrame:
    return c.table("events").select("event_id", convert.to_double(_texts(), _TEXT).alias("from_text"), convert.to_double(F.col("event_id") % 2 == 1, T.BooleanType()).alias("from_bool"))


@query(f"SELECT event_id, ({_NUMBER_SQL}) IS NOT NULL AS ok FROM events")
def c_valid(c: Catalog) -> DataFrame:
    return c.table("events").select("event_id", convert.valid(_texts(), _TEXT, "double").alias("ok"))


@query(f"SELECT doc_id, coalesce(quality, 0)::BIGINT AS quality, coalesce(is_toxic, false) AS is_toxic FROM {_LABELLED}")
def c_default(c: Catalog) -> DataFrame:
    return _labelled(c).select("doc_id", convert.or_default(F.col("quality").cast("long"), "int").alias("quality"), convert.or_default(F.col("is_toxic"), "bool").alias("is_toxic"))


@query(
    "SELECT p_partkey, (p_size | (2::BIGINT << 16) | (17::BIGINT << 22) | ((p_partkey % 100) << 30))::BIGINT AS key, p_size::BIGINT AS \"index\", "
    "(p_partkey % 100)::BIGINT AS tag FROM part"
)
def c_column_keys(c: Catalog) -> DataFrame:
    key = pack_column_key(F.col("p_size"), F.lit(2), F.lit(17), F.col("p_partkey") % 100)
    parts = unpack_column_key(F.col("key"))
    return c.table("part").select("p_partkey", key.alias("key")).select("p_partkey", "key", parts["index"].alias("index"), parts["tag"].alias("tag"))


# Statistics.
@query(
    "SELECT count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (cached) AS cached, "
    "count(*) FILTER (compiled) AS compiled, sum(memory)::BIGINT AS sum_memory, max(memory) AS peak_memory, sum(results)::BIGINT AS results, count(*) FILTER (results = 0) AS empty, count(*) FILTER (results > 1000) AS large, min(nanos) AS min_nanos, "
    "max(nanos) AS max_nanos, sum(nanos)::BIGINT AS sum_nanos, (sum(nanos) // count(*))::BIGINT AS avg_nanos, count(*) FILTER (complexity <= 1) AS simple, "
    "count(*) FILTER (complexity > 1 AND complexity <= 5) AS medium, count(*) FILTER (complexity > 5) AS complex FROM (SELECT event_type <> 'error' AS ok, "
    "event_id % 3 = 0 AS cached, event_id * 17 % 1009 AS nanos, user_id * 13 % 1500 AS results, event_id % 9 AS complexity, event_id % 4 = 1 AS compiled, event_id * 31 % 4099 AS memory FROM events)"
)
def o_metrics_rollup(c: Catalog) -> DataFrame:
    history = c.table("events").select(
        (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 3 == 0).alias("cached"), (F.col("event_id") * 17 % 1009).alias("nanos"),
        (F.col("user_id") * 13 % 1500).alias("results"), (F.col("event_id") % 9).alias("complexity"),
        (F.col("event_id") % 4 == 1).alias("compiled"), (F.col("event_id") * 31 % 4099).alias("memory"),
    )
    return rollup(history)


@query(
    "SELECT count(*) AS by_key, greatest(count(*) // 2, 1) AS by_text, greatest(count(*) * 3 // 10, 1) AS by_number, 2::BIGINT AS by_bool, "
    "greatest(count(*) // 5, 1) AS by_other FROM orders"
)
def o_cardinality_estimate(c: Catalog) -> DataFrame:
    n = F.col("n")
    return c.table("orders").agg(F.count("*").alias("n")).select(
        estimated_cardinality(n, "int", True).alias("by_key"), estimated_cardinality(n, "string").alias("by_text"),
        estimated_cardinality(n, "int").alias("by_number"), estimated_cardinality(n, "bool").alias("by_bool"), estimated_cardinality(n, "link").alias("by_other"),
    )


# Streams.
@query(
    "SELECT (rn // 50)::BIGINT AS chunk_id, count(*) AS n, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key "
    "FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) GROUP BY 1"
)
def t_batches(c: Catalog) -> DataFrame:
    numbered = ResultStream(c.table("orders").select("o_orderkey"), "o_orderkey").numbered(50)
    return numbered.groupBy(F.col("batch").alias("chunk_id")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"))


@query("SELECT event_id, event_type, value FROM events WHERE value > 90")
def t_filtered_stream(c: Catalog) -> DataFrame:
    stream = files.read(c.spark, c.path, c.table("events"), "events.parquet")
    return files.drain(files.filtered(stream, F.col("value") > 90).select("event_id", "event_type", "value"))


# Tables: reading, writing, metadata.
@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def s_keys(c: Catalog) -> DataFrame:
    return _orders(c).where("o_orderstatus = 'P'").keys()


@query("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def s_point_read(c: Catalog) -> DataFrame:
    return dml.get_fields(c.table("customer"), 77, ["c_name", "c_acctbal"], "c_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT max(n_nationkey) + 1, 'NEW' FROM nation WHERE n_regionkey <> 1")
def s_flush(c: Catalog) -> DataFrame:
    """A catalog is written, opened, changed, and written to where it was opened; then it is opened again."""
    path = storage.new_folder(c.spark, "catalog")
    spec = TableSpec("nation", (ColumnSpec("n_nationkey", "int"), ColumnSpec("n_name", "string", True), ColumnSpec("n_regionkey", "int", True)), "n_nationkey")
    first = Catalog(c.spark)
    first.register("nation", c.table("nation").select(*[F.col(x.name).cast(x.spark_type()) for x in spec.columns]), spec)
    first.flush(path)
    again = Catalog.open(c.spark, path)
    left = dml.delete(again.table("nation"), F.col("n_regionkey") == 1)
    again.register("nation", dml.insert(left, {"n_name": "NEW"}, key=again.key("nation")), again.spec("nation"))
    again.flush(path)
    return Catalog.open(c.spark, path).table("nation").select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def s_compact(c: Catalog) -> DataFrame:
    path = storage.new_folder(c.spark, "compact")
    c.table("orders").select("o_orderkey", "o_orderstatus").repartition(12).write.parquet(path)
    storage.compact(c.spark, path, path)
    return c.spark.read.parquet(path)


@query("SELECT name AS column_name, cid::INTEGER AS place FROM pragma_table_info('orders')")
def s_table_metadata(c: Catalog) -> DataFrame:
    """A specification, through its JSON and back."""
    own = TableSpec("orders", tuple(ColumnSpec(f.name, "mixed", True) for f in c.table("orders").schema.fields))
    back = TableSpec.from_json(own.to_json())
    return c.spark.createDataFrame([(x.name, i) for i, x in enumerate(back.columns)], "column_name string, place int")


@query("SELECT event_type AS key, arg_max(user_id, event_id)::VARCHAR AS value FROM events WHERE event_type <> 'click' GROUP BY 1 UNION ALL SELECT 'owner', count(*)::VARCHAR FROM nation")
def s_metadata(c: Catalog) -> DataFrame:
    """Versions of keys, one removed and one put."""
    all_of = c.table("events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").cast("binary").alias("value"))
    kept = put_metadata(remove_metadata(all_of, "click"), "owner", str(c.table("nation").count()).encode())
    return current_metadata(kept).select("key", F.col("value").cast("string").alias("value"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS place, n_nationkey FROM nation WHERE n_regionkey <> 2")
def s_iterator(c: Catalog) -> DataFrame:
    rows = RowIterator(c.table("nation"), "n_nationkey", where=lambda r: r["n_regionkey"] != 2)
    found = []
    while rows.has_next():
        key = rows.next()["n_nationkey"]
        found.append((rows.position, key))
    return c.spark.createDataFrame(found, "place long, n_nationkey long")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'none' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey = 7 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def m_batch_set(c: Catalog) -> DataFrame:
    orders = c.table("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return dml.set_fields(orders, 7, {"o_orderpriority": "none", "o_totalprice": 0.0}, key="o_orderkey")


@query("SELECT doc_id, list_sort(list_distinct(list_filter(string_split(text[1:40], ' '), lambda x: x <> ''))) AS words FROM documents")
def m_set_column(c: Catalog) -> DataFrame:
    words = F.filter(F.split(F.substring("text", 1, 40), " "), lambda x: x != "")
    return c.table("documents").select("doc_id", dml.as_set(words).alias("words"))


_SPEC = TableSpec("labelled", (ColumnSpec("doc_id", "int"), ColumnSpec("quality", "int"), ColumnSpec("toxic", "int"), ColumnSpec("n_chars", "int", True)), "doc_id")


@query(f"SELECT doc_id, list_filter([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END], lambda x: x IS NOT NULL) AS missing FROM {_LABELLED} WHERE quality IS NULL OR toxic IS NULL")
def m_rejected(c: Catalog) -> DataFrame:
    return dml.rejected(_labelled(c), _SPEC).select("doc_id", F.col("_missing").alias("missing"))


@query(f"SELECT * FROM (SELECT 'quality' AS \"column\", count(*) FILTER (quality IS NULL) AS rows FROM {_LABELLED} UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM {_LABELLED}) WHERE rows > 0")
def m_violations(c: Catalog) -> DataFrame:
    return violations(_labelled(c), _SPEC)


# Predicates and views, the rest.
@query("SELECT r_regionkey, r_name LIKE 'A%' AS matches FROM region")
def p_evaluate(c: Catalog) -> DataFrame:
    asked = Query(c.table("region"), "r_regionkey").where("r_name LIKE 'A%'")
    return c.spark.createDataFrame([(k, asked.evaluate(k)) for k in range(c.table("region").count())], "r_regionkey long, matches boolean")


@query("SELECT c_custkey FROM customer WHERE c_name >= 'Customer#000000500' AND c_name < 'Customer#000000700'")
def p_binary(c: Catalog) -> DataFrame:
    names = c.table("customer").select("c_custkey", F.col("c_name").cast("binary").alias("b"))
    return Query(names, "c_custkey").where("b >= 'Customer#000000500' AND b < 'Customer#000000700'").matches().select("c_custkey")


@query("SELECT p_partkey FROM part WHERE starts_with(lower(p_brand), 'brand#1') AND p_partkey >= 50 AND p_partkey < 1500")
def v_string_positions(c: Catalog) -> DataFrame:
    return bulk.find_positions(c.table("part"), "p_partkey", "p_brand", "BEGINSWITH", "BRAND#1", 50, 1500, case_sensitive=False)


@query(
    "SELECT count(*) AS size, count(*) = 0 AS is_empty, min(n_nationkey) AS first_key, (SELECT n_nationkey FROM nation WHERE n_regionkey >= 2 ORDER BY 1 LIMIT 1 OFFSET 3) "
    "AS fourth_key FROM nation WHERE n_regionkey >= 2"
)
def r_view(c: Catalog) -> DataFrame:
    view = Query(c.table("nation"), "n_nationkey").where("n_regionkey >= 2").find_all()
    return c.spark.createDataFrame([(view.size(), view.is_empty(), view.key_at(0), view.key_at(3))], "size long, is_empty boolean, first_key long, fourth_key long")


@query("SELECT 0::BIGINT AS cleared, count(*) + 1 AS synced, max(n_nationkey) + 1 AS last_key FROM nation")
def r_view_sync(c: Catalog) -> DataFrame:
    """A view that is cleared and then follows a table that has grown."""
    held = {"nation": c.table("nation")}
    view = Query(lambda: held["nation"], "n_nationkey").find_all()
    cleared = view.clear().size()
    held["nation"] = dml.insert(held["nation"], {"n_name": "NEW"}, key="n_nationkey")
    view.do_sync()
    return c.spark.createDataFrame([(cleared, view.size(), view.key_at(view.size() - 1))], "cleared long, synced long, last_key long")


@query("SELECT count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation WHERE n_regionkey = 3")
def r_for_each(c: Catalog) -> DataFrame:
    seen: list[int] = []
    n = Query(c.table("nation"), "n_nationkey").where("n_regionkey = 3").find_all().for_each(lambda r: seen.append(r["n_nationkey"]))
    return c.spark.createDataFrame([(n, sum(seen))], "n long, total long")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey >= 15 ORDER BY 1")
def r_collect(c: Catalog) -> DataFrame:
    found = Query(c.table("nation"), "n_nationkey").where("n_nationkey >= 15").find_all().collect()
    return c.spark.createDataFrame([(r["n_nationkey"],) for r in found], "n_nationkey long")


@query("SELECT event_id FROM events WHERE event_id % 7 = 3")
def u_key_callback(c: Catalog) -> DataFrame:
    return where_key(c.table("events").select("event_id"), "event_id", lambda k: k % 7 == 3)


@query("SELECT p.key, p.value FROM (SELECT n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT 3, 'renamed' UNION ALL SELECT 99, 'added') p")
def x_changes(c: Catalog) -> DataFrame:
    """Insert, set and erase; clearing leaves nothing to put back."""
    own = index.postings(c.table("nation"), "n_nationkey", "n_name")
    own = index.erase(index.replace(index.put(index.put(own, "added", 99), "added", 99), 3, "renamed"), 4)
    return own.unionByName(index.clear(own)).select("key", "value")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 131")
def x_lookup(c: Catalog) -> DataFrame:
    return index.lookup(c.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 131)


@query(
    "SELECT o_orderkey, o_totalprice, previous FROM (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS previous FROM orders) WHERE previous >= o_totalprice"
)
def x_verify_order(c: Catalog) -> DataFrame:
    return index.disorder(c.table("orders"), "o_totalprice", "o_orderkey")


@query(
    "SELECT user_id, event_id, value, previous FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous >= value"
)
def x_verify_order_in_groups(c: Catalog) -> DataFrame:
    return index.disorder(c.table("events"), "value", "event_id", "user_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 350000 AND o_orderkey % 2 = 0 ORDER BY o_orderkey")
def x_conditional(c: Catalog) -> DataFrame:
    condition = (F.col("o_totalprice") > 350000) & (F.col("o_orderkey") % 2 == 0)
    return index.where_ordered(c.table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", condition)


@query(
    "SELECT p.p_partkey, r.range_id FROM part p JOIN (SELECT event_id AS range_id, event_id - event_id % 11 * event_id AS a, event_id + event_id % 5 * event_id AS b FROM events "
    "WHERE event_id % 50 = 0) r ON p.p_partkey BETWEEN r.a AND r.b"
)
def x_wide_range_join(c: Catalog) -> DataFrame:
    """Ranges of all lengths, from one key to more than the table has."""
    e = F.col("event_id")
    ranges = c.table("events").where(e % 50 == 0).select(e.alias("range_id"), (e - e % 11 * e).alias("start"), (e + e % 5 * e).alias("end"))
    return index.range_join(c.table("part").select("p_partkey"), "p_partkey", ranges).select("p_partkey", "range_id")


# Execution and streams.
@query(
    "SELECT name, greatest(1, least(1024, (n + 7) // 8)) AS rows FROM (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'part', count(*) FROM part "
    "UNION ALL SELECT 'orders', count(*) FROM orders)"
)
def e_chunk_rows(c: Catalog) -> DataFrame:
    sizes = [(t, chunk_rows(c.table(t).count(), 4)) for t in ("region", "part", "orders")]
    return c.spark.createDataFrame(sizes, "name string, rows long")


@query("SELECT count(*) AS in_time, true AS interrupted FROM orders")
def e_time_limit(c: Catalog) -> DataFrame:
    """A query within its time, and one whose time is over before it starts."""
    in_time = run_interruptibly(c.spark, lambda: c.table("orders").count(), Cancel(600))
    try:
        process(c.table("region"), "r_regionkey", lambda key, i: None, Cancel(0))
        interrupted = False
    except Interrupted:
        interrupted = True
    return c.spark.createDataFrame([(in_time, interrupted)], "in_time long, interrupted boolean")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")
def u_processor(c: Catalog) -> DataFrame:
    seen: list[tuple] = []
    process(c.table("nation"), "n_nationkey", lambda key, i: seen.append((key, i)))
    return c.spark.createDataFrame(seen, "n_nationkey long, place long")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS position FROM nation WHERE n_regionkey < 3")
def t_result_stream(c: Catalog) -> DataFrame:
    stream = ResultStream(c.table("nation"), "n_nationkey", F.col("n_regionkey") < 3)
    return c.spark.createDataFrame([(r["n_nationkey"], stream.position) for r in stream], "n_nationkey long, position long")


@query("SELECT (rn // 4)::BIGINT AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rn FROM nation) GROUP BY 1")
def t_stream_batches(c: Catalog) -> DataFrame:
    batches = ResultStream(c.table("nation"), "n_nationkey").batches(4)
    return c.spark.createDataFrame([(i, len(b)) for i, b in enumerate(batches)], "batch long, n long")


@query("SELECT least(10, count(*)) AS taken, count(*) AS size, false AS done FROM nation")
def t_cancel(c: Catalog) -> DataFrame:
    """A stream that is stopped after ten rows."""
    stream, taken = ResultStream(c.table("nation"), "n_nationkey"), 0
    try:
        for _ in stream:
            taken += 1
            if taken == 10:
                stream.stop()
    except Interrupted:
        pass
    return c.spark.createDataFrame([(taken, stream.size(), stream.done)], "taken long, size long, done boolean")


# Schemas, the rest.
def _two_schemas(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Two schemas made of the parts: an object for each brand, a property for each part, attributes by number."""
    part = c.table("part").select(F.col("p_brand").alias("object"), F.col("p_partkey").cast("string").alias("property"), "p_partkey", "p_size")
    ends = part.groupBy("object").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b"))
    k = F.col("p_partkey")
    kinds = lambda i: F.element_at(F.array(F.lit("int"), F.lit("string"), F.lit("double")), (i % 3 + 1).cast("int"))

    def made(rows: DataFrame, kind: Column, primary: Column, indexed: Column, nullable: Column, table: Column) -> DataFrame:
        off = F.lit(False)
        return rows.select(
            "object", "property", F.lit("").alias("public_name"), kind.alias("type"), F.lit("").alias("object_type"), F.lit("").alias("origin"), primary.alias("is_primary"),
            indexed.alias("is_indexed"), off.alias("is_fulltext"), nullable.alias("is_nullable"), (k % 17 == 0).alias("is_computed"), table.alias("table_type"), F.lit(0).alias("ordinal"),
        )

    rows = part.join(ends, "object")
    old = made(rows.where((k % 10 != 1) & ~F.col("object").endswith("5")), kinds(k), k == F.col("a"), k % 4 == 0, k % 6 == 0, F.lit("top_level"))
    kind = F.when(F.col("object").endswith("3"), "embedded").otherwise("top_level")
    new = made(rows.where((k % 10 != 2) & ~F.col("object").endswith("4")), kinds(F.when(k % 7 == 0, k + 1).otherwise(k)), k == F.col("b"), k % 8 < 4, k % 5 == 0, kind)
    return old, new


_SCHEMAS = """WITH p AS (SELECT p_brand AS object, p_partkey AS k, p_partkey::VARCHAR AS property, min(p_partkey) OVER (PARTITION BY p_brand) AS a,
max(p_partkey) OVER (PARTITION BY p_brand) AS b FROM part),
o AS (SELECT object, property, k % 3 AS type, k = a AS pk, k % 4 = 0 AS idx, k % 6 = 0 AS nul, 'top_level' AS tt FROM p WHERE k % 10 <> 1 AND NOT ends_with(object, '5') AND k % 17 <> 0),
n AS (SELECT object, property, CASE WHEN k % 7 = 0 THEN (k + 1) % 3 ELSE k % 3 END AS type, k = b AS pk, k % 8 < 4 AS idx, k % 5 = 0 AS nul,
CASE WHEN ends_with(object, '3') THEN 'embedded' ELSE 'top_level' END AS tt FROM p WHERE k % 10 <> 2 AND NOT ends_with(object, '4') AND k % 17 <> 0),
ot AS (SELECT object, any_value(tt) AS tt, coalesce(max(CASE WHEN pk THEN property END), '') AS pk FROM o GROUP BY 1),
nt AS (SELECT object, any_value(tt) AS tt, coalesce(max(CASE WHEN pk THEN property END), '') AS pk FROM n GROUP BY 1),
t AS (SELECT coalesce(ot.object, nt.object) AS object, ot.tt AS ott, nt.tt AS ntt, ot.pk AS opk, nt.pk AS npk FROM ot FULL JOIN nt ON ot.object = nt.object),
kept AS (SELECT object FROM t WHERE ott IS NOT NULL AND ntt IS NOT NULL),
f AS (SELECT coalesce(o.object, n.object) AS object, coalesce(o.property, n.property) AS property, o.type AS ot, n.type AS nt, o.nul AS onul, n.nul AS nnul, o.idx AS oidx, n.idx AS nidx
FROM (SELECT * FROM o WHERE object IN (FROM kept)) o FULL JOIN (SELECT * FROM n WHERE object IN (FROM kept)) n ON o.object = n.object AND o.property = n.property),
d AS (SELECT object, '' AS property, 'AddTable' AS change FROM t WHERE ott IS NULL UNION ALL SELECT object, '', 'AddInitialProperties' FROM t WHERE ott IS NULL
UNION ALL SELECT object, '', 'RemoveTable' FROM t WHERE ntt IS NULL UNION ALL SELECT object, '', 'ChangeTableType' FROM t WHERE ott <> ntt
UNION ALL SELECT object, npk, 'ChangePrimaryKey' FROM t WHERE opk <> npk AND npk <> '' UNION ALL SELECT object, property, 'AddProperty' FROM f WHERE ot IS NULL
UNION ALL SELECT object, property, 'RemoveProperty' FROM f WHERE nt IS NULL UNION ALL SELECT object, property, 'ChangePropertyType' FROM f WHERE ot <> nt
UNION ALL SELECT object, property, 'MakePropertyNullable' FROM f WHERE NOT onul AND nnul UNION ALL SELECT object, property, 'MakePropertyRequired' FROM f WHERE onul AND NOT nnul
UNION ALL SELECT object, property, 'AddIndex' FROM f WHERE NOT oidx AND nidx UNION ALL SELECT object, property, 'RemoveIndex' FROM f WHERE oidx AND NOT nidx)"""


@query(f"{_SCHEMAS} SELECT object, property, change FROM d")
def g_diff_kinds(c: Catalog) -> DataFrame:
    """All twelve kinds of change."""
    return schema.diff(*_two_schemas(c))


@query(f"{_SCHEMAS} SELECT change, count(*) AS n FROM d WHERE property = '' GROUP BY 1")
def g_visit(c: Catalog) -> DataFrame:
    """Changes of tables, counted by a visitor."""
    n: dict[str, int] = {}
    changes = [r.asDict() for r in schema.diff(*_two_schemas(c)).where("property = ''").collect()]  # a few a table
    schema.visit(changes, {}, other=lambda x: n.update({x["change"]: n.get(x["change"], 0) + 1}))
    return c.spark.createDataFrame(list(n.items()), "change string, n long")


@query(
    "SELECT p_brand AS object, p_partkey::VARCHAR AS property, 'primary key is nullable' AS problem FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand) AS a FROM part) "
    "WHERE p_partkey = a AND p_partkey % 6 = 0 AND p_partkey % 10 <> 1 AND NOT ends_with(p_brand, '5')"
)
def g_validate_parts(c: Catalog) -> DataFrame:
    return schema.validate(_two_schemas(c)[0])


def _schema_of(c: Catalog, *names: str) -> DataFrame:
    return schema.of_tables(c.spark, {n: c.table(n) for n in names}, {n: c.key(n) for n in names})


@query("SELECT 'orders' AS object, name AS property, cid::INTEGER AS ordinal, name = 'o_orderkey' AS is_primary FROM pragma_table_info('orders')")
def g_find(c: Catalog) -> DataFrame:
    return schema.find(_schema_of(c, "region", "orders", "part"), "orders").select("object", "property", "ordinal", "is_primary")


@query("SELECT 'part' AS object, name AS property FROM pragma_table_info('part')")
def g_find_by_table_key(c: Catalog) -> DataFrame:
    keys = c.spark.createDataFrame([("region", 1), ("part", 2)], "object string, table_key long")
    return schema.find_by_table_key(_schema_of(c, "region", "part"), keys, 2).select("object", "property")


@query("SELECT table_name AS object, column_name AS property FROM (SELECT 'region' AS table_name, name AS column_name FROM pragma_table_info('region') UNION ALL SELECT 'nation', name FROM pragma_table_info('nation')) WHERE column_name LIKE '%_name'")
def g_find_property(c: Catalog) -> DataFrame:
    both = _schema_of(c, "region", "nation")
    return schema.find_property(both, "r_name").unionAll(schema.find_property(both, "n_name")).select("object", "property")


@query("SELECT true AS same, count(*) = 0 AS reversed_is_same, true AS same_unordered FROM pragma_table_info('orders')")
def g_equal(c: Catalog) -> DataFrame:
    own = _schema_of(c, "orders")
    turned = own.withColumn("ordinal", F.lit(own.count() - 1) - F.col("ordinal"))
    found = (schema.equal(own, _schema_of(c, "orders")), schema.equal(own, turned), schema.equal(own, turned, ordered=False))
    return c.spark.createDataFrame([found], "same boolean, reversed_is_same boolean, same_unordered boolean")


@query("SELECT 'orders' AS name, 4 AS version, count(*)::INTEGER AS properties FROM pragma_table_info('orders') UNION ALL SELECT 'region', 1, count(*)::INTEGER FROM pragma_table_info('region')")
def g_store(c: Catalog) -> DataFrame:
    """Stored schemas, one of them a second time and one removed."""
    store = schema.SchemaStore(c.spark.createDataFrame([], "key string, seq long, value binary"))
    for name, version in (("orders", 3), ("region", 1), ("part", 1), ("orders", 4)):
        store.store(name, _schema_of(c, name), version)
    store.remove("part")
    store.validate("orders", _schema_of(c, "orders"), 4)
    return store.frame()


@query("SELECT p_partkey, p_size * 2 AS twice, p_size * 2 + 1 AS more FROM part")
def g_migrate(c: Catalog) -> DataFrame:
    steps = {2: lambda d: d.withColumn("twice", F.col("p_size") * 2), 3: lambda d: d.withColumn("more", F.col("twice") + 1)}
    return schema.migrate(c.table("part").select("p_partkey", "p_size"), 1, 3, steps).select("p_partkey", "twice", "more")


@query("SELECT p_partkey, (p_size & 1) <> 0 AS indexed, (p_size | 2)::BIGINT AS with_unique, (p_size & ~1)::BIGINT AS without_index FROM part")
def g_attributes(c: Catalog) -> DataFrame:
    bits = F.col("p_size")
    return c.table("part").select(
        "p_partkey", has_attribute(bits, "indexed").alias("indexed"), set_attribute(bits, "unique").cast("long").alias("with_unique"),
        clear_attribute(bits, "indexed").cast("long").alias("without_index"),
    )


# Links, versions and log, the rest.
@query("SELECT o_custkey AS target, o_orderkey + 1 AS origin FROM orders a WHERE o_orderkey % 9 = 0 AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey = a.o_orderkey + 1)")
def k_invalid_backlinks(c: Catalog) -> DataFrame:
    orders = c.table("orders")
    claimed = orders.where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("target"), (F.col("o_orderkey") + 1).alias("origin"))
    return links.invalid_backlinks(claimed, orders, "o_custkey", "o_orderkey")


@query(
    "SELECT o_custkey AS target, list_append(o, 5) AS added, CASE WHEN list_position(o, 3) > 0 THEN list_concat(o[:list_position(o, 3) - 1], o[list_position(o, 3) + 1:]) ELSE o END AS removed, "
    "len(list_filter(o, lambda x: x = 1))::INTEGER AS of_type FROM (SELECT o_custkey, list(o_orderkey % 10 ORDER BY o_orderkey % 10) AS o FROM orders GROUP BY 1)"
)
def k_link_sets(c: Catalog) -> DataFrame:
    sets = links.backlink_lists(c.table("orders").withColumn("k", F.col("o_orderkey") % 10), "o_custkey", "k")
    o = F.col("origins")
    typed = F.transform(o, lambda x: F.struct(F.lit(1).cast("long").alias("table_key"), x.alias("obj_key"), x.cast("int").alias("type_info")))
    return sets.select(
        "target", links.set_add(o, F.lit(5).cast("long")).alias("added"), links.set_remove(o, F.lit(3).cast("long")).alias("removed"),
        links.set_size(links.typed_of_type(typed, 1)).alias("of_type"),
    )


@query(
    "SELECT target, len(list_filter(o, lambda x: x = 4)) > 0 AS has_4 FROM (SELECT o_custkey AS target, list(o_orderkey % 10) AS o FROM orders GROUP BY 1)"
)
def k_typed_link_sets(c: Catalog) -> DataFrame:
    sets = links.backlink_lists(c.table("orders").withColumn("k", F.col("o_orderkey") % 10), "o_custkey", "k")
    typed = F.transform("origins", lambda x: F.struct(F.lit(1).cast("long").alias("table_key"), x.alias("obj_key"), F.lit(0).alias("type_info")))
    return sets.select("target", links.typed_contains_target(typed, F.lit(1), F.lit(4)).alias("has_4"))


@query(
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))"
)
def k_cascade_levels(c: Catalog) -> DataFrame:
    """Customers go, with them their orders, and with those their lines."""
    gone = Query(c.table("customer"), "c_custkey").where("c_acctbal < 0").matches()
    levels = [(c.table("orders"), "o_orderkey", "o_custkey"), (c.table("lineitem"), "l_orderkey", "l_orderkey")]
    return links.cascade(gone, "c_custkey", levels)[1].select("l_orderkey", "l_linenumber")


@query(
    "WITH RECURSIVE g AS (SELECT p_partkey AS k FROM part WHERE p_partkey IN (3, 5) UNION SELECT p_partkey FROM part JOIN g ON p_partkey // 3 = g.k AND p_partkey > 2) "
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (FROM g)"
)
def k_cascade_tree(c: Catalog) -> DataFrame:
    """Parts as a tree, each below a third of its number; two branches go."""
    part = c.table("part").select("p_partkey", F.when(F.col("p_partkey") > 2, F.expr("p_partkey div 3")).alias("parent"))
    return links.cascade_tree(part, "p_partkey", "parent", part.where("p_partkey IN (3, 5)"), "p_partkey").select("p_partkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def n_transaction(c: Catalog) -> DataFrame:
    """One transaction that is committed, one that fails, and one that runs out of time: only the first takes effect."""
    versions, table = versioning.Versions(), c.table("nation")
    with versioning.transaction(versions, table, seconds=600) as t:
        t.apply(lambda d: d.where("n_regionkey <> 1"))
    for seconds, error in ((None, ValueError), (0.0, versioning.TransactionTimeout)):
        try:
            with versioning.transaction(versions, t.table, seconds) as other:
                other.apply(lambda d: d.limit(0))
                raise ValueError
        except error:
            t.table = other.table
    return t.table.select("n_nationkey", "n_name")


@query("SELECT count(*) AS current_version, count(*) - 2 AS oldest_snapshot, 3::BIGINT AS versions, 1::BIGINT AS snapshots FROM nation")
def n_versions(c: Catalog) -> DataFrame:
    """A version for each nation, a snapshot, and what is left when the versions before it are collected."""
    versions = versioning.Versions()
    for _ in range(c.table("nation").count()):
        versions.create()
    versions.snapshot(versions.current - 2)
    versions.release(versions.snapshot())
    versions.collect()
    found = versions.statistics()
    return c.spark.createDataFrame([tuple(found[k] for k in ("current_version", "oldest_snapshot", "versions", "snapshots"))], "current_version long, oldest_snapshot long, versions long, snapshots long")


@query(
    "SELECT v, ts FROM (SELECT event_id // 10 AS v, max(ts) AS ts FROM events GROUP BY 1) WHERE NOT (v < 300 AND ts < TIMESTAMP '2024-01-03 00:00:00') ORDER BY v DESC LIMIT 400"
)
def n_collected(c: Catalog) -> DataFrame:
    events = c.table("events").select(F.expr("event_id div 10").alias("v"), "ts")
    return versioning.collected(events, "v", "ts", 300, F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"), 400)


@query("SELECT event_id AS version FROM (SELECT DISTINCT event_id FROM events) ORDER BY 1 DESC LIMIT 100")
def n_newest_versions(c: Catalog) -> DataFrame:
    return versioning.newest_versions(c.table("events").select(F.col("event_id").alias("version")), "version", 100)


@query(
    "SELECT user_id, event_id, stage, previous FROM (SELECT *, lag(stage) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM (SELECT user_id, event_id, "
    "list_extract(['ready', 'reading', 'writing', 'committing', 'rolling_back'], (event_id * 7 % 5 + 1)::INTEGER) AS stage FROM events)) WHERE previous IS NOT NULL AND NOT ("
    "previous = 'ready' AND stage IN ('reading', 'writing') OR previous = 'reading' AND stage IN ('ready', 'rolling_back') OR previous = 'writing' AND stage IN ('committing', 'rolling_back') "
    "OR previous = 'committing' AND stage IN ('ready', 'rolling_back') OR previous = 'rolling_back' AND stage = 'ready')"
)
def n_stages(c: Catalog) -> DataFrame:
    stages = F.array(*[F.lit(x) for x in ("ready", "reading", "writing", "committing", "rolling_back")])
    log = c.table("events").select("user_id", "event_id", F.element_at(stages, (F.col("event_id") * 7 % 5 + 1).cast("int")).alias("stage"))
    return versioning.bad_transitions(log, "user_id", "event_id", "stage")


_CHECKSUM = "list_reduce(list_transform(string_split(pos || '|' || type || '|' || txn || '|' || version || '|' || data, ''), lambda x: ascii(x)), lambda a, b: xor(a, b))::INTEGER"


@query(f"SELECT pos, {_CHECKSUM} AS checksum FROM {_LOG}")
def w_seal(c: Catalog) -> DataFrame:
    return wal.seal(_log(c)).select("pos", "checksum")


@query(f"SELECT pos FROM {_LOG} WHERE pos < (SELECT min(pos) FROM {_LOG} WHERE pos % 3571 = 17)")
def w_repair(c: Catalog) -> DataFrame:
    """Some entries are changed after they were sealed: what stands before the first is kept."""
    log = wal.seal(_log(c))
    broken = log.withColumn("data", F.when(F.col("pos") % 3571 == 17, F.concat("data", F.lit("!"))).otherwise(F.col("data")))
    return wal.repair(broken).select("pos")


@query(f"SELECT pos FROM {_LOG} WHERE pos % 3571 = 17")
def w_corrupt(c: Catalog) -> DataFrame:
    log = wal.seal(_log(c))
    return wal.corrupt(log.withColumn("version", F.when(F.col("pos") % 3571 == 17, F.col("version") * 10 + 1).otherwise(F.col("version")))).select("pos")


@query(f"SELECT (SELECT arg_max(version, pos) FROM {_LOG} WHERE type = 'COMMIT') AS last_committed, count(*) FILTER (state = 'pending') AS pending, 0::BIGINT AS corrupt FROM {_TXNS}")
def w_recover(c: Catalog) -> DataFrame:
    found = wal.recover(wal.seal(_log(c)))
    return c.spark.createDataFrame([(found["last_committed"], found["pending"], found["corrupt"])], "last_committed long, pending long, corrupt long")


@query(f"SELECT pos, type, txn FROM {_LOG} WHERE pos < 500 UNION ALL SELECT 499 + row_number() OVER (ORDER BY pos), type, txn FROM {_LOG} WHERE pos >= 500 AND pos % 3 = 0")
def w_append(c: Catalog) -> DataFrame:
    """Entries added at the end, in the order of their time."""
    log = wal.seal(_log(c).where("pos < 500"))
    more = _log(c).where("pos >= 500 AND pos % 3 = 0").select("type", "txn", "version", F.col("pos").alias("ts"), "data")
    return wal.append(log.withColumn("ts", F.col("pos")), more).select("pos", "type", "txn")


@query("SELECT event_id, event_id % 600 >= 300 OR event_id * 100 >= 1048576 OR user_id >= 1800 AS due FROM events")
def w_checkpoint_due(c: Catalog) -> DataFrame:
    e = F.col("event_id")
    return c.table("events").select("event_id", wal.checkpoint_due(e % 600, e * 100, F.col("user_id")).alias("due"))


@query(f"SELECT max(pos) FILTER (pos % 1000 = 0) AS checkpoint_pos, arg_max(version, pos) FILTER (pos % 1000 = 0) AS checkpoint_version, max(pos) AS log_pos FROM {_LOG}")
def w_checkpoint_statistics(c: Catalog) -> DataFrame:
    marked = _log(c).withColumn("type", F.when(F.col("pos") % 1000 == 0, "CHECKPOINT").otherwise(F.col("type")))
    return wal.checkpoint_statistics(marked).select("checkpoint_pos", "checkpoint_version", "log_pos")


@query("SELECT event_id AS seq, event_type AS text FROM events ORDER BY event_id DESC LIMIT 1000")
def o_history(c: Catalog) -> DataFrame:
    return newest(c.table("events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("text")), 1000)


@query("SELECT p_partkey, 512.0::DOUBLE / p_size + 10.0 AS by_text, 512.0::DOUBLE / p_size AS by_index FROM part WHERE p_size > 0")
def o_node_cost(c: Catalog) -> DataFrame:
    distance = F.col("p_size").cast("double")
    return c.table("part").where("p_size > 0").select("p_partkey", node_cost(distance, "string").alias("by_text"), node_cost(distance, "index").alias("by_index"))


# What is left: creation, maps of equalities, printing, caches, registries, keys.
@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 3")
def s_create(c: Catalog) -> DataFrame:
    """A new table, filled row by row."""
    own = Catalog(c.spark)
    spec = TableSpec("made", (ColumnSpec("id", "int"), ColumnSpec("name", "string", True)), "id")
    own.create(spec)
    names = [r["n_name"] for r in c.table("nation").where("n_nationkey < 3").orderBy("n_nationkey").collect()]
    for i, name in enumerate(names):
        row = c.spark.createDataFrame([(i, name)], own.table("made").schema)
        own.register("made", dml.upsert(own.table("made"), row, "id"), spec)
    return own.table("made").select("id", "name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def m_map_delete(c: Catalog) -> DataFrame:
    where = dml.matching({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return dml.delete(c.table("orders"), where).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def m_map_update(c: Catalog) -> DataFrame:
    orders = c.table("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return dml.update(orders, {"o_orderpriority": "closed"}, dml.matching({"o_orderstatus": "F"})).select("o_orderkey", "o_orderpriority")


_PRINTED = "NOT (p_size < 10 OR p_name CONTAINS 'a') AND p_brand IN ('Brand#11', 'Brand#13', 'Brand#25') AND p_size BETWEEN 12 AND 44"


@query(
    "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR contains(p_name, 'a')) AND p_brand IN ('Brand#11', 'Brand#13', 'Brand#25') AND p_size BETWEEN 12 AND 44"
)
def p_printed(c: Catalog) -> DataFrame:
    """A predicate that is parsed, printed and parsed again."""
    return Query(c.table("part"), "p_partkey").where(str(parse(_PRINTED))).matches().select("p_partkey")


@query("SELECT n_nationkey + 1 AS tests, 2 * (n_nationkey + 1) - 1 AS complexity FROM nation")
def o_complexity(c: Catalog) -> DataFrame:
    texts = [" AND ".join(f"x > {i}" for i in range(n + 1)) for n in range(c.table("nation").count())]
    return c.spark.createDataFrame([(i + 1, complexity(parse(t))) for i, t in enumerate(texts)], "tests long, complexity long")


@query("SELECT 2 * count(*) AS hits, count(*) AS misses, least(count(*), 10) AS kept, greatest(count(*) - 10, 0) AS evicted FROM (SELECT n_nationkey FROM nation LIMIT 10)")
def o_plan_cache(c: Catalog) -> DataFrame:
    """Ten predicates, asked for three times each."""
    cache = PlanCache(limit=10)
    for _ in range(3):
        for k in range(10):
            cache.get(f"n_nationkey = {k}", c.table("nation").schema)
    return c.spark.createDataFrame([(cache.hits, cache.misses, len(cache), cache.evicted)], "hits long, misses long, kept long, evicted long")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey <> 1")
def e_registry(c: Catalog) -> DataFrame:
    """A running query for each nation; those of one region are cancelled, and forgotten."""
    manager = QueryManager()
    for r in c.table("nation").collect():
        manager.register(r["n_name"])
        if r["n_regionkey"] == 1:
            manager.cancel(r["n_name"])
    manager.clean()
    return c.spark.createDataFrame([(n,) for n in manager.names()], "name string")


@query("SELECT name, \"type\" IN ('BIGINT', 'INTEGER', 'VARCHAR', 'BOOLEAN', 'TIMESTAMP') AS supported FROM pragma_table_info('orders')")
def x_supported(c: Catalog) -> DataFrame:
    return c.spark.createDataFrame([(f.name, index.supports(f.dataType)) for f in c.table("orders").schema.fields], "name string, supported boolean")


@query("SELECT p_partkey, concat(" + ", ".join(f"lpad(lower(to_hex((p_partkey >> {8 * i}) & 255)), 2, '0')" for i in range(8)) + ") AS bytes FROM part")
def c_key_bytes(c: Catalog) -> DataFrame:
    """Keys as bytes, the lowest first."""
    return c.table("part").select("p_partkey", little_endian_hex(F.col("p_partkey")).alias("bytes"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest finished orders: text predicate, order, top hundred."""
    found = _orders(Catalog(spark, sf_dir)).where("o_orderstatus = 'F' AND o_totalprice > 200000")
    return found.sort(("o_totalprice", False)).top_k(100)
