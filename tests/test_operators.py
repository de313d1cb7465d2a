"""Operators on the small fixtures, with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvid.functions import convert, keys
from korvid.functions.compare import compare_values, in_order
from korvid.functions.text import fold_ascii, tokenise
from korvid.operators import bulk, dml, index, links, schema, versioning, wal
from korvid.operators.query import Query, RowIterator, chunk_rows, chunk_stats, chunks, first, last, members_of, select, slice_rows, where_key
from korvid.sources import catalog, storage
from korvid.sources.spec import ColumnSpec, SpecError, TableSpec, attribute_bits, check_value, clear_attribute, duplicates, has_attribute, set_attribute, violations


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        (1, "kayak", "water", 640.0, 3, "two seats"), (2, "paddle", "water", 45.5, 31, "ash wood"), (3, "bail", "water", 8.25, 70, None),
        (4, "rope", "climb", 64.0, 12, "dry, 60 m"), (5, "map", "paper", 11.0, 44, None), (6, "dry bag", "water", 27.75, 18, "20 litres"),
        (7, "tent", "camp", 310.0, 6, "three seasons"), (8, "stove", "camp", 112.4, 9, "multi-fuel"),
    ]
    return spark.createDataFrame(rows, "id long, name string, category string, price double, stock long, description string")


def test_products(products):
    q = Query(products, "id")
    assert q.where("category = 'water'").count().first()["n"] == 4
    assert q.where("category = 'camp'").count().first()["n"] == 2
    assert q.where("price >= 100").find_all().size() == 3
    assert q.where("description = NULL").count().first()["n"] == 2
    assert q.where("category = 'water' AND price < 100.0").find_all().key_at(0) == 2
    assert [r["n"] for r in chunk_stats(products, "id", 3).orderBy("chunk_id").collect()] == [3, 3, 2]
    assert sorted(column(chunks(products, "id", 3), "row_index")) == list(range(8))
    assert chunk_stats(products.limit(0), "id", 3).count() == 0


def test_limit_is_not_top_k(spark):
    df = spark.createDataFrame([(1, "Ines", 41), (2, "Marek", 57), (3, "Odile", 23), (4, "Tomasz", 49), (5, "Yuki", 66)], "id long, name string, score long")
    q = Query(df, "id").sort(("score", False))
    assert column(q.limit(3).frame(), "score") == [57, 41, 23]
    assert column(q.top_k(3), "score") == [66, 57, 49]
    assert column(Query(df, "id").sort("score").frame(), "score") == [23, 41, 49, 57, 66]
    assert q.where("score > 40").find_first().first()["id"] == 1
    assert q.evaluate(3) and not q.where("score > 40").evaluate(3)
    assert column(q.page(1, 2), "score") == [57, 49]


def test_views(spark):
    source = {"df": spark.createDataFrame([(i, 10 * i) for i in range(1, 11)], "id long, value long")}
    view = Query(lambda: source["df"], "id").where("value > 20").find_all()
    assert view.size() == 8 and not view.is_empty() and view.key_at(0) == 3 and view.key_at(99) is None and view.key_at(-1) is None
    assert view.query().where("value < 50").find_all().size() == 2
    assert view.clear().is_empty() and not view.in_sync
    source["df"] = dml.insert(source["df"], {"value": 500}, key="id")
    assert view.do_sync().size() == 9 and view.in_sync
    assert len(list(view)) == 9


def test_nulls_sort_first(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 1)], "id long, v long")
    assert column(Query(df, "id").sort("v").frame(), "id") == [1, 3, 4, 2]
    assert column(Query(df, "id").sort(("v", False)).frame(), "id") == [2, 4, 1, 3]


def test_iteration(products):
    rows = RowIterator(products, "id")
    assert rows.has_next() and rows.next()["id"] == 1 and rows.skip(5) == 5 and rows.next()["id"] == 7 and rows.position == 7
    assert rows.skip(9) == 1 and not rows.has_next()
    with pytest.raises(StopIteration):
        rows.next()
    rows.reset()
    assert len(list(rows)) == 8
    assert column(slice_rows(products, "id", 2, 4), "id") == [3, 4] and first(products, "id").first()["id"] == 1 and last(products, "id").first()["id"] == 8
    assert column(select(products, ["name"], {"description": None}, "id", 1, 1), "name") == ["map"]


def test_bulk(spark):
    ints = spark.createDataFrame([(k, v) for k, v in enumerate([1, 5, 10, 15, 20, 25, 30])] + [(7, None)], "k long, v long")
    assert {r["op"]: r["matches"] for r in bulk.match_counts(ints, "v", [("=", 15), (">", 15)]).collect()} == {"=": 1, ">": 3}
    assert column(bulk.find_positions(ints, "k", "v", ">", 15, 0, 6), "k") == [4, 5]
    assert column(bulk.mask(ints, "v", "=", 15).orderBy("k"), "mask") == [False] * 3 + [True] + [False] * 4
    words = spark.createDataFrame([(["gravel", "basalt", "chertstone", "shale", "limestone", None],)], "w array<string>")
    assert words.select(bulk.array_mask(F.col("w"), "CONTAINS", "STON", False).alias("m")).first()["m"] == [False, False, True, False, True, False]


def test_text(spark):
    df = spark.createDataFrame([("Hello, World! hello 2x-3",), ("É",), ("",), (None,)], "t string")
    assert [sorted(x) if x is not None else None for x in column(df.select(tokenise(F.col("t")).alias("x")), "x")] == [["2x", "3", "hello", "world"], [], [], None]
    assert column(df.select(fold_ascii(F.col("t")).alias("x")), "x")[1] == "É"


def test_index(spark):
    df = spark.createDataFrame([(1, "alder"), (2, "birch"), (3, "al"), (4, None)], "id long, name string")
    p = index.postings(df, "id", "name")
    assert p.count() == 3 and index.count(p, "birch").first()["n"] == 1 and column(index.find_prefix(p, "al"), "key") == [1, 3]
    p = index.put(index.put(p, "birch", 9), "birch", 9)
    assert column(index.find_all(p, "birch").orderBy("key"), "key") == [2, 9] and index.find_first(p, "birch").first()["key"] == 2
    assert index.erase(p, 9).count() == 3 and index.erase(p, 9, "alder").count() == 4 and index.duplicates(p).isEmpty()
    assert index.find_all(index.replace(p, 1, "yew"), "alder").isEmpty()
    ordered = spark.createDataFrame([(1, "oak"), (2, "pine"), (3, "rowan")], "k long, v string")
    assert index.seek(ordered, "k", 2).first()["v"] == "pine" and index.step(ordered, "k", 2).first()["v"] == "rowan"
    assert index.step(ordered, "k", 2, False).first()["v"] == "oak" and index.step(ordered, "k", 3).isEmpty()
    assert column(index.key_range(ordered, "k", 2, 3), "v") == ["pine", "rowan"]
    assert index.multi_range(ordered, "k", [(1, 2), (2, 3)]).count() == 4
    ranges = spark.createDataFrame([(0, 1, 2), (1, 2, 30)], "range_id int, start long, end long")
    assert index.range_join(ordered, "k", ranges, 4).count() == 4
    assert index.supports(T.StringType()) and not index.supports(T.DoubleType())
    texts = spark.createDataFrame([(1, "a b a"), (2, "B c"), (3, None)], "id long, t string")
    assert column(index.search(texts, "id", "t", ["B"]).orderBy("id"), "id") == [1, 2]
    assert {r["token"]: r["n"] for r in index.document_frequencies(texts, "id", "t").collect()} == {"a": 1, "b": 2, "c": 1}


def test_links(spark):
    targets = spark.createDataFrame([(100, "north pier"), (200, "south pier")], "_obj_key long, name string")
    sources = spark.createDataFrame([(1, 100), (2, 300), (3, None), (4, 0)], "id long, link long")
    got = {r["id"]: r["name"] for r in links.follow(sources, "link", targets, "_obj_key", ["name"]).collect()}
    assert got == {1: "north pier", 2: None, 3: None, 4: None}
    assert sorted(column(links.dangling(sources, "link", targets, "_obj_key"), "id")) == [2, 4]
    assert column(sources.where(links.unresolved(F.col("link"), True)), "id") == [3, 4]
    assert {r["_obj_key"]: r["n_links"] for r in links.backlink_counts(targets, "_obj_key", sources, "link").collect()} == {100: 1, 200: 0}
    wrong = spark.createDataFrame([(100, 1), (100, 2)], "target long, origin long")
    assert column(links.invalid_backlinks(wrong, sources, "link", "id"), "origin") == [2]
    with pytest.raises(ValueError):
        links.follow(targets, "_obj_key", targets, "_obj_key", ["name"])
    typed = spark.createDataFrame([(1, "t", 100), (2, "x", 1), (3, None, 100)], "id long, table string, link long")
    assert {r["id"]: r["target_value"] for r in links.follow_typed(typed, "table", "link", {"t": (targets, "_obj_key", "name")}).collect()} == {1: "north pier", 2: None, 3: None}


def test_link_sets(spark):
    df = spark.createDataFrame([([5, 7, 5],)], "l array<long>")
    l, five = F.col("l"), F.lit(5).cast("long")
    row = df.select(links.set_add(l, five).alias("a"), links.set_remove(l, five).alias("r"), links.set_remove(l, F.lit(9).cast("long")).alias("n"), links.set_contains(l, five).alias("c"), links.set_size(l).alias("s")).first()
    assert (row["a"], row["r"], row["n"], row["c"], row["s"]) == ([5, 7, 5, 5], [7, 5], [5, 7, 5], True, 3)
    typed = spark.createDataFrame([([(1, 10, 2), (1, 11, 2), (2, 10, 0)],)], "l array<struct<table_key:long,obj_key:long,type_info:int>>")
    got = typed.select(F.size(links.typed_of_type(F.col("l"), 2)).alias("n"), links.typed_contains_target(F.col("l"), F.lit(2), F.lit(10)).alias("y"), links.typed_contains_target(F.col("l"), F.lit(2), F.lit(11)).alias("z")).first()
    assert (got["n"], got["y"], got["z"]) == (2, True, False)


def users(spark, *properties, **more):
    rows = [{"object": "User", **p} for p in properties]
    rows += [{"object": o, **p} for o, ps in more.items() for p in ps]
    return schema.properties(spark, rows)


def test_diff(spark):
    pk = {"property": "id", "type": "int", "is_primary": True}
    name = {"property": "name", "type": "string", "is_nullable": True}
    v1 = users(spark, pk, name, {"property": "age", "type": "string", "is_nullable": True})
    kinds = lambda a, b: sorted((r["property"], r["change"]) for r in schema.diff(a, b).collect())
    v2 = users(spark, pk, name, {"property": "age", "type": "int", "is_nullable": True})
    assert kinds(v1, v2) == [("age", "ChangePropertyType")]
    email = {"property": "email", "type": "string", "is_nullable": True}
    v3 = users(spark, pk, name, {"property": "age", "type": "string", "is_nullable": True}, email)
    assert kinds(v1, v3) == [("email", "AddProperty")] and kinds(v3, v1) == [("email", "RemoveProperty")]
    base = users(spark, pk, name)
    assert kinds(base, users(spark, pk, name, Product=[pk])) == [("", "AddInitialProperties"), ("", "AddTable")]
    assert kinds(users(spark, pk, name, Product=[pk]), base) == [("", "RemoveTable")]
    assert kinds(base, users(spark, pk, {**name, "is_indexed": True})) == [("name", "AddIndex")]
    assert kinds(base, users(spark, pk, {**name, "is_nullable": False})) == [("name", "MakePropertyRequired")]
    assert kinds(base, users(spark, {**pk, "is_primary": False}, {**name, "is_primary": True})) == [("name", "ChangePrimaryKey")]
    assert kinds(base, users(spark, {**pk, "is_primary": False}, name)) == []
    assert kinds(base, users(spark, pk, {**name, "is_computed": True})) == [("name", "RemoveProperty")]
    assert schema.equal(v1, v1) and not schema.equal(v1, v2)
    assert schema.describe({"object": "User", "property": "age", "change": "AddIndex"}) == "AddIndex(User.age)"


def test_validate_and_migrate(spark):
    bad = users(spark, {"property": "id", "type": "int", "is_primary": True, "is_nullable": True}, {"property": "", "type": "int"}, {"property": "l", "type": "link", "object_type": "None"}, {"property": "id", "type": "int"})
    assert sorted(column(schema.validate(bad), "problem")) == ["link target is missing", "primary key is nullable", "property has no name", "property is declared twice"]
    df = spark.createDataFrame([(1, "x", None), (2, "7", 3)], "id long, age string, n long")
    done = schema.apply(df, "User", [{"object": "User", "property": "age", "change": "ChangePropertyType"}, {"object": "User", "property": "n", "change": "MakePropertyRequired"}, {"object": "Other", "property": "id", "change": "RemoveProperty"}], {"age": "int", "n": "int"})
    assert [tuple(r) for r in done.collect()] == [(1, None, 0), (2, None, 3)]
    steps = {2: lambda d: d.withColumn("a", F.lit(2)), 3: lambda d: d.withColumn("b", F.col("a") + 1)}
    assert schema.migrate(df, 1, 3, steps).first()["b"] == 3
    with pytest.raises(KeyError):
        schema.migrate(df, 1, 4, steps)


def test_specs(spark):
    spec = TableSpec("users", (ColumnSpec("id", "int"), ColumnSpec("name", "string", nullable=True)), primary_key="id").validate()
    with pytest.raises(SpecError):
        spec.add(ColumnSpec("x" * 65, "int"))
    with pytest.raises(SpecError):
        spec.add(ColumnSpec("id", "int"))
    with pytest.raises(SpecError):
        TableSpec("u", spec.columns, primary_key="name").validate()
    with pytest.raises(SpecError):
        spec.with_attribute("name", "primary_key")
    for value, c in ((None, "id"), ("x", "id"), (True, "id"), (5, "name")):
        with pytest.raises(SpecError):
            check_value(spec.column(c), value)
    check_value(spec.column("name"), None)
    indexed = spec.with_attribute("name", "indexed").with_attribute("id", "unique")
    assert indexed.with_attributes_of("indexed") == ["name"] and indexed.with_attribute("name", "indexed", False) == spec.with_attribute("id", "unique")
    more = spec.add(ColumnSpec("l", "string", True, "list")).add(ColumnSpec("s", "int", False, "set")).add(ColumnSpec("d", "int", True, "dict", "string"))
    assert more.collections() == ["l", "s", "d"] and more.hash() != spec.hash() and TableSpec.from_json(more.to_json()) == more
    assert more.schema()["d"].dataType == T.MapType(T.StringType(), T.LongType())
    assert more.remove("id").primary_key is None
    df = spark.createDataFrame([(1, None), (None, "x"), (1, "y")], "id long, name string")
    assert [tuple(r) for r in violations(df, spec).collect()] == [("id", 1)]
    assert [tuple(r) for r in duplicates(df, "id").collect()] == [(1, 2)]
    bits = spark.range(1).select(F.lit(attribute_bits(["indexed", "nullable"])).alias("b"))
    row = bits.select(has_attribute(F.col("b"), "indexed").alias("i"), has_attribute(set_attribute(F.col("b"), "unique"), "unique").alias("u"), clear_attribute(F.col("b"), "indexed").alias("c")).first()
    assert (row["i"], row["u"], row["c"]) == (True, True, 16)
    with pytest.raises(SpecError):
        TableSpec("e", kind="embedded").validate()


def test_dml(spark):
    spec = TableSpec("users", (ColumnSpec("_obj_key", "int"), ColumnSpec("name", "string"), ColumnSpec("age", "int", True)))
    df = spark.createDataFrame([], spec.schema())
    df = dml.insert(df, {"name": "Ruth Okoro", "age": 30}, spec)
    df = dml.insert(df, {"name": "Emil Vance"}, spec)
    assert sorted((r["_obj_key"], r["name"], r["age"]) for r in df.collect()) == [(1, "Ruth Okoro", 30), (2, "Emil Vance", None)]
    df = dml.set_fields(df, 2, {"age": 26}, spec)
    assert dml.get_fields(df, 2, ["age"]).first()["age"] == 26
    assert column(dml.delete(df, F.col("_obj_key") == 1), "name") == ["Emil Vance"]
    with pytest.raises(SpecError):
        dml.set_fields(df, 2, {"name": None}, spec)
    with pytest.raises(SpecError):
        dml.insert(df, {"nothing": 1})
    wide = dml.add_column(df, ColumnSpec("tags", "string", True, "list"))
    assert column(wide, "tags") == [None, None] and dml.drop_column(wide, "tags").columns == df.columns
    assert column(dml.rejected(dml.insert(df, {}), spec), "_missing") == [["name"]]
    new = spark.createDataFrame([(2, "Emilia", 1), (9, "Zoe", 2)], df.schema)
    assert sorted(column(dml.upsert(df, new), "name")) == ["Emilia", "Ruth Okoro", "Zoe"]
    assert spark.createDataFrame([([3, 1, 3],)], "x array<long>").select(dml.as_set(F.col("x")).alias("x")).first()["x"] == [1, 3]


def test_versions(spark):
    df = spark.createDataFrame([(1, 1, "a", False), (1, 3, "b", False), (2, 2, "c", False), (2, 4, None, True)], "k long, v long, x string, gone boolean")
    at = lambda n: sorted((r["k"], r["x"]) for r in versioning.as_of(df, "k", "v", n, ["x"], "gone").collect())
    assert at(2) == [(1, "a"), (2, "c")] and at(4) == [(1, "b")] and at(0) == []
    assert sorted(column(versioning.retained(df, "k", "v", 3), "v")) == [2, 3, 4]
    assert column(versioning.newest_versions(df, "v", 2), "v") == [4, 3]
    v = versioning.Versions()
    assert v.oldest() == 0 and v.create() == 1 and v.create() == 2
    one, two = v.snapshot(1), v.snapshot()
    assert v.oldest() == 1 and v.retain(one) == 2 and v.release(one) == 1 and v.release(one) == 0 and v.oldest() == 2
    two.tables["users"] = 1
    assert two.version_of("users") == 1 and two.version_of("x") == 2
    seen = spark.createDataFrame([(3,), (7,), (None,)], "v long").where(versioning.visible(F.col("v"), F.lit(None), "serializable", 5, F.lit(None)))
    assert column(seen, "v") == [3]
    log = spark.createDataFrame([(1, 1, "ready"), (1, 2, "writing"), (1, 3, "ready")], "txn long, seq long, stage string")
    assert column(versioning.bad_transitions(log, "txn", "seq", "stage"), "seq") == [3]
    with pytest.raises(ValueError):
        versioning.check_transition("none", "completed", versioning.ASYNC_STAGES)


def test_transactions(spark):
    v = versioning.Versions()
    df = spark.range(3)
    with versioning.transaction(v, df) as t:
        t.apply(lambda d: d.where("id > 0"))
    assert t.table.count() == 2 and t.version == 1 and t.stage == "ready" and v.oldest() == 0
    with pytest.raises(RuntimeError), versioning.transaction(v, df) as t:
        t.apply(lambda d: d.where("id > 0"))
        raise RuntimeError
    assert t.table.count() == 3 and v.current == 1 and t.sees(1) and not t.sees(2)


def test_log(spark):
    rows = [(1, "BEGIN", 1, 0), (2, "OP", 1, 0), (3, "BEGIN", 2, 0), (4, "COMMIT", 1, 5), (5, "OP", 2, 0), (6, "BEGIN", 3, 0), (7, "ROLLBACK", 3, 0), (8, "CHECKPOINT", None, 5), (9, "OP", 2, 0)]
    log = wal.seal(spark.createDataFrame([(*r, "d") for r in rows], "pos long, type string, txn long, version long, data string"))
    body = log.where(F.col("txn").isNotNull())
    assert wal.recover(body) == {"last_committed": 5, "pending": 1, "corrupt": 0}
    assert [tuple(r) for r in wal.pending(body).collect()] == [(2, 2)] and sorted(column(wal.pending_entries(body), "pos")) == [5, 9]
    assert column(wal.compact(log), "pos") == [9]
    broken = log.withColumn("data", F.when(F.col("pos") == 5, "e").otherwise(F.col("data")))
    assert column(wal.corrupt(broken), "pos") == [5] and sorted(column(wal.repair(broken), "pos")) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        wal.recover(body.where("pos > 1"))
    assert wal.checkpoint_due(0, 1 << 20, 0) and wal.checkpoint_due(301, 0, 0) and not wal.checkpoint_due(1, 1, 1)
    assert spark.range(1).select(wal.xor_bytes(F.lit("ab")).alias("x"), wal.xor_bytes(F.lit("")).alias("y")).first()[:] == (3, 0)
    entries = spark.createDataFrame([("OP", 2, 0, "z", 5), ("OP", 2, 0, "y", 4)], "type string, txn long, version long, data string, ts long")
    full = wal.append(log.withColumn("ts", F.col("pos")), entries)
    assert [r["data"] for r in full.where("pos > 9").orderBy("pos").collect()] == ["y", "z"] and wal.corrupt(full).isEmpty()


def test_conversions(spark):
    df = spark.createDataFrame([("12",), ("2.9",), (" 3",), ("T",), ("x",), (None,)], "s string")
    c, kind = F.col("s"), T.StringType()
    assert column(df.select(convert.to_int(c, kind).alias("x")), "x") == [12, None, None, None, None, None]
    assert column(df.select(convert.to_bool(c, kind).alias("x")), "x") == [True, True, None, True, None, None]
    assert column(df.select(convert.valid(c, kind, "double").alias("x")), "x") == [True, True, False, False, False, True]
    assert column(df.select(convert.convert_column(c, kind, "int").alias("x")), "x") == [None] * 6
    row = spark.range(1).select(convert.to_int(F.lit(-2.9), T.DoubleType()).alias("i"), convert.to_double(F.lit(True), T.BooleanType()).alias("d"), convert.to_bool(F.lit(0), T.LongType()).alias("b"), convert.or_default(F.lit(None), "string").alias("s")).first()
    assert row[:] == (-2, 1.0, False, "")


def test_keys(spark):
    link = keys.TypedLink(7, 1 << 40, 3)
    assert keys.TypedLink.decode(link.encode()) == link and len(link.encode()) == 13 and not link.is_null
    assert keys.ObjectLink.decode(keys.ObjectLink(1, 2).encode()) == keys.ObjectLink(1, 2) and keys.ObjectLink(0, 2).is_null
    assert keys.decode_keys(keys.encode_keys([1, 2, 1 << 50])) == [1, 2, 1 << 50] and keys.decode_key(keys.encode_key(258, 4)) == 258
    with pytest.raises(ValueError):
        keys.check_range(0, 5)
    with pytest.raises(ValueError):
        keys.ObjectLink.decode(b"short")
    assert spark.range(1).select(keys.little_endian_hex(F.lit(258)).alias("x")).first()["x"] == "0201000000000000"


def test_catalog(spark, tmp_path, data):
    c = catalog.Catalog(spark, data)
    assert c.table("region").count() == 5 and c.key("orders") == "o_orderkey" and c.names() == ["region"]
    with pytest.raises(KeyError):
        catalog.Catalog(spark).table("x")
    own = catalog.Catalog(spark)
    spec = TableSpec("t", (ColumnSpec("id", "int"),), primary_key="id")
    own.create(spec)
    with pytest.raises(SpecError):
        own.create(spec)
    own.register("t", dml.insert(own.table("t"), {}, key="id"), spec)
    assert own.flush(f"file://{tmp_path}/db") == 1
    again = catalog.Catalog.open(spark, f"file://{tmp_path}/db")
    assert again.table("t").count() == 1 and again.spec("t") == spec and again.key("t") == "id" and again.refresh("t").count() == 1
    assert storage.compact(spark, f"{again.path}/t.parquet", f"file://{tmp_path}/small") == 1
    own.drop("t")
    assert own.names() == []
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader raises
        catalog.Catalog.open(spark, f"file://{tmp_path}/nothing")


def test_flush_to_where_it_was_opened(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    first = catalog.Catalog(spark)
    first.register("t", spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"), TableSpec("t", (ColumnSpec("id", "int"), ColumnSpec("x", "string", True)), "id"))
    first.register("u", spark.range(3))
    first.flush(path)
    for number in (2, 3, 4):
        own = catalog.Catalog.open(spark, path)
        own.register("t", dml.insert(own.table("t"), {"x": "new"}, key="id"), own.spec("t"))
        assert own.flush(path) == number and own.table("t").count() == number + 1
    again = catalog.Catalog.open(spark, path)
    assert again.names() == ["t", "u"] and again.table("u").count() == 3 and again.key("t") == "id"
    assert catalog.generations(spark, path) == [3, 4]

    @F.udf("string")
    def fails(x):
        raise RuntimeError

    own = catalog.Catalog.open(spark, path)
    own.register("u", own.table("u").select(fails("id").alias("id")))
    with pytest.raises(Exception):  # noqa: B017 - whatever the job raises
        own.flush(path)
    assert catalog.Catalog.open(spark, path).table("u").count() == 3 and catalog.generations(spark, path) == [3, 4]


def test_storage(spark, tmp_path):
    path = f"file://{tmp_path}/one"
    storage.flush(spark.range(5), path)
    kept = storage.flush(spark.read.parquet(path).where("id <> 2"), path)
    assert sorted(column(kept, "id")) == [0, 1, 3, 4] and storage.compact(spark, path, path) == 1 and spark.read.parquet(path).count() == 4
    with pytest.raises(Exception):  # noqa: B017
        storage.flush(spark.read.parquet(path).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 4 and len(list(tmp_path.iterdir())) == 1
    made = storage.materialise(spark.range(3))
    folder = made.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(folder) and storage.clean(spark) >= 1 and not os.path.isdir(folder)


def test_metadata(spark):
    m = spark.createDataFrame([], "key string, seq long, value binary")
    m = catalog.put_metadata(catalog.put_metadata(catalog.put_metadata(m, "a", b"1"), "b", b"2"), "a", b"3")
    assert {r["key"]: bytes(r["value"]) for r in catalog.current_metadata(m).collect()} == {"a": b"3", "b": b"2"}
    assert column(catalog.current_metadata(catalog.remove_metadata(m, "a")), "key") == ["b"]


def test_compare(spark):
    rows = [("2", 10.0), (None, 1.0), ("x", None), ("3", 2.5), ("5", None)]
    df = spark.createDataFrame(rows, "a string, b double")
    got = df.select(compare_values(F.col("a"), T.StringType(), F.col("b"), T.DoubleType(), "double").alias("c"))
    assert column(got, "c") == [-1, -1, 0, 1, 1]
    binary = spark.createDataFrame([(b"ab", b"b"), (b"b", b"ab"), (b"", b"")], "a binary, b binary")
    assert column(binary.select(compare_values(F.col("a"), T.BinaryType(), F.col("b"), T.BinaryType(), "binary").alias("c")), "c") == [-1, 1, 0]
    assert column(df.orderBy(in_order(F.col("b"), False)), "b") == [10.0, 2.5, 1.0, None, None]


def test_members_and_callbacks(spark):
    df = spark.range(20)
    assert sorted(column(members_of(df, "id", spark.createDataFrame([(3,), (3,), (99,), (None,)], "v long")), "id")) == [3]
    assert sorted(column(where_key(df, "id", lambda k: k % 7 == 0), "id")) == [0, 7, 14]
    assert [chunk_rows(n, 4) for n in (0, 5, 100, 10**6)] == [1, 1, 13, 1024]


def test_bucketed_tables_join_without_shuffle(spark, data):
    orders = storage.save_bucketed(spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_custkey"), "b_orders", "o_custkey", 4)
    customers = storage.save_bucketed(spark.read.parquet(f"{data}/customer.parquet").select("c_custkey", "c_name"), "b_customer", "c_custkey", 4)
    joined = orders.hint("merge").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == orders.count()


def test_last_write_wins_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (1, 1, "c"), (None, None, "d"), (2, 5, None)], "k long, v long, x string")
    assert sorted(map(tuple, catalog.last_by(df, ["k"], ["v"]).collect()), key=str) == [(1, 2, "b"), (2, 5, None), (None, None, "d")]


def test_schema_store_and_search(spark):
    v1 = users(spark, {"property": "id", "type": "int", "is_primary": True}, {"property": "name", "type": "string", "public_name": "label"}, Pier=[{"property": "id", "type": "int"}])
    store = schema.SchemaStore(spark.createDataFrame([], "key string, seq long, value binary"))
    store.store("main", v1, 3)
    store.store("other", v1)
    assert store.names() == ["main", "other"] and store.has("main") and store.version("main") == 3 and schema.equal(store.load("main"), v1)
    store.validate("main", v1, 3)
    for changed, version in ((v1, 4), (v1.where("property <> 'name'"), 3)):
        with pytest.raises(SpecError):
            store.validate("main", changed, version)
    store.remove("main")
    assert store.names() == ["other"] and not store.has("main") and sorted(tuple(r) for r in store.frame().collect()) == [("other", 1, 3)]
    with pytest.raises(KeyError):
        store.load("main")
    assert schema.find(v1, "Pier").count() == 1 and sorted(column(schema.find_property(v1, "label"), "property")) == ["name"]
    tables = spark.createDataFrame([("User", 7), ("Pier", 8)], "object string, table_key long")
    assert set(column(schema.find_by_table_key(v1, tables, 7), "object")) == {"User"} and schema.find_by_table_key(v1, tables, 9).isEmpty()
    turned = users(spark, {"property": "name", "type": "string", "public_name": "label"}, {"property": "id", "type": "int", "is_primary": True}, Pier=[{"property": "id", "type": "int"}])
    assert not schema.equal(v1, turned) and schema.equal(v1, turned, ordered=False)


def test_every_kind_of_change_is_carried_out(spark):
    pk = {"property": "id", "type": "int", "is_primary": True}
    old = users(spark, pk, {"property": "a", "type": "int"}, {"property": "b", "type": "string", "is_indexed": True}, Gone=[pk], Kept=[pk])
    new = users(
        spark, {**pk, "is_primary": False}, {"property": "a", "type": "int", "is_nullable": True, "is_indexed": True}, {"property": "b", "type": "string", "is_primary": True},
        {"property": "c", "type": "double", "is_nullable": True}, Fresh=[pk, {"property": "x", "type": "string"}], Kept=[{**pk, "table_type": "asymmetric"}],
    )
    changes = [r.asDict() for r in schema.diff(old, new).collect()]
    own = catalog.Catalog(spark)
    own.register("User", spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "id long, a long, b string"))
    own.register("Gone", spark.range(1))
    own.register("Kept", spark.range(3))
    schema.apply_to(own, changes, new)
    assert own.names() == ["Fresh", "Kept", "User"] and own.table("Fresh").columns == ["id", "x"] and own.table("User").columns == ["id", "a", "b", "c"]
    assert own.key("User") == "b" and own.spec("Kept").kind == "asymmetric" and own.spec("User").column("a").nullable
    about = own.table("User").schema
    assert about["a"].metadata == {"nullable": True, "indexed": True} and about["b"].metadata == {"indexed": False, "primary_key": True}
    seen = []
    assert schema.visit(changes, {"AddTable": seen.append}, other=lambda c: None) == len(changes) and [c["object"] for c in seen] == ["Fresh"]
    assert schema.same_changes(changes, list(changes)) and not schema.same_changes(changes, changes[1:])
    with pytest.raises(ValueError):
        schema.visit(changes, {})
    with pytest.raises(ValueError):
        schema.apply(own.table("Kept"), "Kept", [{"object": "Kept", "property": "", "change": "RemoveTable"}], {})
    twice = spark.createDataFrame([(1,), (1,)], "id long")
    with pytest.raises(ValueError):
        schema.apply(twice, "t", [{"object": "t", "property": "id", "change": "ChangePrimaryKey"}], {})


def test_transactions_run_out_of_time(spark):
    import time

    v = versioning.Versions()
    with pytest.raises(versioning.TransactionTimeout), versioning.transaction(v, spark.range(3), seconds=0.05) as t:
        t.apply(lambda d: d.where("id > 0"))
        time.sleep(0.3)
    assert t.timed_out and t.table.count() == 3 and v.current == 0 and v.oldest() == 0 and t.remaining() == 0
    with versioning.transaction(v, spark.range(3), seconds=60) as t:
        t.apply(lambda d: d.where("id > 0"))
    assert v.current == 1 and not t.timed_out and 0 <= t.elapsed() < 60
    for _ in range(5):
        v.create()
    held = v.snapshot(4)
    assert v.collect(age_seconds=1000) == 0 and v.collect() == 3 and v.collect(limit=1) == 2
    assert v.statistics() == {"current_version": 6, "versions": 1, "snapshots": 1, "oldest_snapshot": 4, "isolation_level": "repeatable_read", "gc_runs": 3, "versions_collected": 5}
    v.release(held)
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40), (2, 25)], "v long, at long")
    assert sorted(column(versioning.collected(df, "v", "at", 3, 22), "v")) == [2, 3, 4]
    assert sorted(column(versioning.collected(df, "v", "at", 3, 99, 1), "v")) == [4]


def test_cascades(spark):
    a, b, c = spark.range(4), spark.createDataFrame([(10, 0), (11, 1), (12, None)], "id long, a long"), spark.createDataFrame([(20, 10), (21, 11), (22, 99)], "id long, b long")
    left = links.cascade(a.where("id = 0"), "id", [(b, "id", "a"), (c, "id", "b")])
    assert [sorted(column(x, "id")) for x in left] == [[11, 12], [21, 22]]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 7), (7, 6)], "id long, up long")
    assert sorted(column(links.cascade_tree(tree, "id", "up", tree.where("id IN (2, 6)"), "id"), "id")) == [1, 5]
    with pytest.raises(ValueError):
        links.backlink_lists(spark.range(30).select("id", (F.col("id") % 2).alias("to")), "to", "id", most=10)
    with pytest.raises(ValueError):
        links.embed(a, "id", spark.range(30).select("id", (F.col("id") % 2).alias("to")), "to", ["id"], "x", most=10)


def test_order_checks_and_far_slices(spark, monkeypatch):
    df = spark.createDataFrame([(i, k) for i, k in enumerate([1, 2, 5, 5, 4, 9])], "at long, k long").repartition(3)
    assert sorted(tuple(r) for r in index.disorder(df, "k", "at").collect()) == [(3, 5, 5), (4, 4, 5)]
    assert index.disorder(df.where("at < 3"), "k", "at").isEmpty() and index.disorder(df, "at", "k", "at").isEmpty()
    wide = spark.createDataFrame([(0, -5, 1 << 40), (1, 3, 3), (2, -(1 << 63), (1 << 63) - 1), (3, 9, 2)], "range_id int, start long, end long")
    keys_of = spark.createDataFrame([(-6,), (-5,), (3,), (1 << 40,), ((1 << 40) + 1,)], "k long")
    got = sorted((r["k"], r["range_id"]) for r in index.range_join(keys_of, "k", wide, 4).collect())
    assert got == sorted((k, i) for (k,) in [(-6,), (-5,), (3,), (1 << 40,), ((1 << 40) + 1,)] for i, a, b in [(0, -5, 1 << 40), (1, 3, 3), (2, -(1 << 63), (1 << 63) - 1)] if a <= k <= b)
    monkeypatch.setattr(storage, "SMALL_OFFSET", 5)
    monkeypatch.setattr("korvid.operators.query.SMALL_OFFSET", 5)
    many = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    q = Query(many, "id").sort(("v", False))
    plain = sorted(range(100), key=lambda i: (-(i % 7), i))
    assert column(q.page(60, 5), "id") == plain[60:65] and [q.find_all().key_at(i) for i in (0, 4, 5, 99, 100)] == [*(plain[i] for i in (0, 4, 5, 99)), None]
    assert column(slice_rows(many, "id", 90, 200), "id") == list(range(90, 100)) and column(select(many, ["id"], None, "id", None, 97), "id") == [97, 98, 99]
    assert index.lookup(many, "id", 5).count() == 1 and index.clear(index.postings(many, "id", "v")).isEmpty()
    index.save(index.postings(many, "id", "v"), "kept_postings", 4)
    assert index.load(spark, "kept_postings").count() == 100
    visited = []
    assert Query(many, "id").where("v = 3").find_all().for_each(lambda r: visited.append(r["id"])) == 14 and visited == sorted(visited)
    assert len(Query(many, "id").find_all().collect()) == 100 and column(Query(many, "id").where("v = 0").keys(), "id") == list(range(0, 100, 7))
    assert [r["id"] for r in RowIterator(many, "id", where=lambda r: r["v"] == 6)] == list(range(6, 100, 7))


def test_checksums_of_long_texts(spark):
    df = spark.range(3).select(F.repeat(F.lit("ab"), 40_000).alias("t"))
    assert column(df.select(wal.xor_bytes(F.concat("t", F.lit("c"))).alias("x")), "x") == [ord("c")] * 3
    log = spark.createDataFrame([(1, "BEGIN", 1, 0, 5), (2, "CHECKPOINT", None, 7, 6), (3, "OP", 1, 0, 9)], "pos long, type string, txn long, version long, ts long")
    assert tuple(wal.checkpoint_statistics(log).first()) == (2, 7, 6, 3)


def test_keys_of_a_range_join_are_not_broadcast(spark):
    """They stand in a cell of each size, which makes them many more than Spark takes them for."""
    own = spark.range(50).select(F.col("id").alias("k"))
    for length in (5, 1 << 30):
        ranges = spark.range(9).select(F.col("id").alias("range_id"), F.col("id").alias("start"), (F.col("id") * length).alias("end"))
        df = index.range_join(own, "k", ranges)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == sum(i <= k <= i * length for k in range(50) for i in range(9))


def test_wide_ranges_meet_in_tiles(spark, monkeypatch):
    """Ranges of all lengths, repeated and null keys, with tiles of few rows and ranges."""
    monkeypatch.setattr(index, "NARROW", 3)
    monkeypatch.setattr(index, "TILE_ROWS", 2)
    monkeypatch.setattr(index, "TILE_RANGES", 2)
    rng = random.Random(7)
    keys = [None, *[5] * 15, *(rng.randrange(-90, 90) for _ in range(60)), 1 << 40, -(1 << 63), (1 << 63) - 1]
    ranges = [(a, a + rng.choice([-3, 0, 1, 8, 50, 300])) for a in (rng.randrange(-120, 120) for _ in range(50))]
    ranges += [(-(1 << 63), (1 << 63) - 1), (5, 5), (1 << 41, 1 << 50), (None, 4), (4, None), *[(-70, 70)] * 9]
    own = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k long").repartition(3)
    for found in (ranges, [(a, b) for a, b in ranges if a is None or b is None or b - a < 8]):
        table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(found)], "range_id int, start long, end long").repartition(2)
        df = index.range_join(own, "k", table)
        assert df.columns == ["id", "k", "range_id", "start", "end"] and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        hits = [(i, k, n, a, b) for i, k in enumerate(keys) for n, (a, b) in enumerate(found) if None not in (k, a, b) and a <= k <= b]
        assert sorted(tuple(r) for r in df.collect()) == sorted(hits)
        assert index.range_join(own.where("k IS NULL"), "k", table).isEmpty()
        pairs = spark.createDataFrame([(k,) for k in (-9, 9)], "k int")
        assert index.range_join(pairs, "k", table).count() == sum(a <= k <= b for k in (-9, 9) for a, b in found if None not in (a, b))


def test_pairs_of_wide_ranges_are_small_in_files(spark, monkeypatch, tmp_path):
    """The result is most of what such a join writes: a row's number in bits for each pair is too much."""
    own = spark.range(3_000).select((F.col("id") * 4).alias("k"))
    ranges = spark.range(2_000).select(F.col("id").alias("range_id"), F.col("id").alias("start"), (F.col("id") * 8).alias("end"))
    for at, least in enumerate((index.LEAST_TILES, 1)):
        monkeypatch.setattr(index, "LEAST_TILES", least)
        index.range_join(own, "k", ranges).select("k", "range_id").write.parquet(str(tmp_path / str(at)))
        n = sum(min(i * 8, 11_996) // 4 - (i + 3) // 4 + 1 for i in range(2_000))
        got = spark.read.parquet(str(tmp_path / str(at)))
        assert (got.count(), got.distinct().count()) == (n, n) and got.where("k < range_id OR k > range_id * 8").isEmpty()
        assert sum(p.stat().st_size for p in (tmp_path / str(at)).glob("*.parquet")) < 0.3 * n


def test_tiles_of_several_cells(spark, monkeypatch):
    """Cells of two rows, four of them and four ranges a tile."""
    for name, value in (("NARROW", 3), ("CELL_ROWS", 1), ("TILE_ROWS", 3), ("TILE_RANGES", 2), ("LEAST_TILES", 1)):
        monkeypatch.setattr(index, name, value)
    rng = random.Random(3)
    keys = [rng.choice([None, *range(-40, 40)]) for _ in range(90)]
    found = [(a, a + rng.choice([0, 2, 9, 60])) for a in (rng.randrange(-50, 50) for _ in range(40))]
    own = spark.createDataFrame([(i, k, [k], {i: k}) for i, k in enumerate(keys)], "id int, k int, l array<int>, m map<int,int>").repartition(3)
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(found)], "range_id int, start int, end int").repartition(2)
    got = index.range_join(own, "k", table).collect()
    assert sorted((r["id"], r["k"], r["range_id"]) for r in got) == sorted((i, k, n) for i, k in enumerate(keys) for n, (a, b) in enumerate(found) if k is not None and a <= k <= b)
    assert all(r["l"] == [r["k"]] and r["m"] == {r["id"]: r["k"]} and (r["start"], r["end"]) == found[r["range_id"]] for r in got)
