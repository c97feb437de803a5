"""Profiles, keys, differences, and whole loads."""

from __future__ import annotations

import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lakeloom.config import LoadConfig
from lakeloom.engine import Engine
from lakeloom.errors import LoadError, SchemaDriftError, SchemaLockTimeoutError
from lakeloom.functions import typesystem as ts
from lakeloom.header import ColumnDef, Header, constraint_name, is_header
from lakeloom.operators import merge, reshape
from lakeloom.plans import ddl, diff, keys, profile, shape
from lakeloom.sources.rows import column_union, frames, from_rows, is_rows, read_jdbc, write_jdbc
from lakeloom.streaming.foreach import batch_loader, load_stream

CONFIG = LoadConfig()


def infer(spark, rows, config=CONFIG, primary_key=()):
    df = from_rows(spark, rows)
    header, stats, n = profile.infer_header(df, config)
    return keys.predict_indexes(header, df, stats, n, config, primary_key)


@pytest.fixture
def engine(spark, tmp_path):
    def make(**options):
        return Engine(spark, f"file://{tmp_path}/store", LoadConfig(**{"add_timestamps": False, **options}))

    return make


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_people_header(spark):
    h = infer(spark, [{"id": i, "name": n, "email": f"{n}@x.com"} for i, n in enumerate(("alice", "bob", "christophe"))])
    assert [(c.type, c.length, c.unique, c.index) for c in h.values()] == [("tinyint", 1, True, True), ("varchar", 10, True, True), ("varchar", 16, True, True)]
    assert h.primary_keys == ["id"] and is_header(h)


def test_nulls_sparse_columns_and_blanks(spark):
    h = infer(spark, [{"id": 1}, {"id": 2}, {"id": 3}, {"id": 4, "code": "X", "blank": None}])
    assert h["code"].allow_null and not h["id"].allow_null and "blank" not in h
    h = infer(spark, [{"a": v, "b": "x"} for v in ("1", "", "null", "\\N", "5")])
    assert h["a"].type == "tinyint" and h["a"].allow_null and h["b"].single_value is False and h["b"].categorical


def test_decimal_precision(spark):
    h = infer(spark, [{"v": "10.5"}, {"v": "20.0"}, {"v": "5.25"}])
    assert (h["v"].type, h["v"].length, h["v"].decimal) == ("decimal", 4, 2)
    h = infer(spark, [{"v": "1.123456"}], LoadConfig(decimal_max_length=2))
    assert (h["v"].length, h["v"].decimal) == (3, 2)
    h = infer(spark, [{"v": "1.123456"}], LoadConfig(decimal_max_length=2, decimal_to_varchar=True))
    assert (h["v"].type, h["v"].length) == ("varchar", 9)


def test_consensus_across_columns(spark):
    us = infer(spark, [{"amt": "1,234", "total": "1,234,567"}, {"amt": "5,678", "total": "2,345,678"}])
    assert us["amt"].type == "smallint" and us["total"].type == "int"
    eu = infer(spark, [{"amt": "1.234", "total": "1.234.567"}])
    assert eu["amt"].type == "smallint"
    said = []
    mixed = infer(spark, [{"a": "1,234.5", "b": "1.234,5"}], LoadConfig(logger={"warn": said.append}))
    assert mixed["a"].type == "decimal" and said
    said.clear()
    infer(spark, [{"a": "1,234"}], LoadConfig(logger={"warn": said.append}))
    assert any("could be read either way" in s for s in said)


def test_hints(spark):
    h = infer(spark, [{"a": "1", "b": 0}, {"a": "2", "b": 1}], LoadConfig(force_string_columns=("a",), boolean_columns=("b",)))
    assert h["a"].type == "varchar" and h["b"].type == "boolean"
    with pytest.raises(ValueError, match="declared boolean"):
        infer(spark, [{"b": "2"}], LoadConfig(boolean_columns=("b",)))


def test_composite_keys(spark):
    pairs = [(1, 101), (2, 102), (2, 104), (3, 103), (3, 105), (4, 104), (5, 105), (6, 101), (6, 102), (6, 103)]
    df = from_rows(spark, [{"order_id": a, "product_id": b, "at": f"2024-03-{i + 1:02d} 12:00:00"} for i, (a, b) in enumerate(pairs)])
    header = Header({"order_id": ColumnDef("int", 11, pseudounique=True), "product_id": ColumnDef("int", 11, pseudounique=True), "at": ColumnDef("datetime", 10)})
    _, stats, n = profile.infer_header(df, CONFIG)
    assert keys.predict_indexes(header, df, stats, n, CONFIG).primary_keys == ["order_id", "product_id"]
    views = [(1001, 1), (1002, 1), (1003, 2), (1001, 3), (1001, 3), (1006, 4)]
    df = from_rows(spark, [{"page_id": a, "user_id": b} for a, b in views])
    header = Header({"page_id": ColumnDef("int", 4, pseudounique=True), "user_id": ColumnDef("int", 4, pseudounique=True)})
    _, stats, n = profile.infer_header(df, CONFIG)
    assert keys.predict_indexes(header, df, stats, n, CONFIG).primary_keys == []
    days = [(1, 1, "2024-03-01"), (1, 1, "2024-03-02"), (2, 1, "2024-03-02"), (2, 3, "2024-03-03")]
    df = from_rows(spark, [{"event_id": a, "user_id": b, "day": c} for a, b, c in days])
    header = Header({"event_id": ColumnDef("int", 11, pseudounique=True), "user_id": ColumnDef("int", 11, pseudounique=True), "day": ColumnDef("date", 10)})
    _, stats, n = profile.infer_header(df, CONFIG)
    assert "day" in keys.predict_indexes(header, df, stats, n, CONFIG).primary_keys
    assert not keys.is_combination_unique(from_rows(spark, [{"a": 1, "b": None}, {"a": 1, "b": None}]), ["a", "b"])


def test_key_choice(spark):
    rows = [{"paid": f"p{i}", "n": i * 1000, "user_id": f"u{i}"} for i in range(5)]
    assert infer(spark, rows).primary_keys == ["user_id"]
    assert infer(spark, [{"paid": r["paid"], "n": r["n"]} for r in rows]).primary_keys == ["n"]
    assert infer(spark, rows, primary_key=["paid"]).primary_keys == ["paid"]


def test_surrogate():
    plain = Header({"a": ColumnDef("varchar", 3)})
    config = LoadConfig(surrogate_key=True)
    made = keys.apply_surrogate(plain, None, config)
    assert list(made) == ["_surrogate_id", "a"] and made.primary_keys == ["_surrogate_id"]
    assert keys.apply_surrogate(Header({"a": ColumnDef("int", primary=True)}), None, config).primary_keys == ["a"]
    with pytest.raises(ValueError):
        keys.apply_surrogate(Header({"_surrogate_id": ColumnDef("int")}), None, config)


def test_diff():
    old = Header({"id": ColumnDef("int", 5, primary=True), "v": ColumnDef("decimal", 5, 2, unique=True), "gone": ColumnDef("date"), "was": ColumnDef("json", 9)})
    new = Header({"id": ColumnDef("bigint", 12), "v": ColumnDef("decimal", 6, 1, allow_null=True), "more": ColumnDef("varchar", 4), "is": ColumnDef("json", 9)})
    changes, merged = diff.compare(old, new)
    assert set(changes.add) == {"more"} and changes.rename == {"was": "is"} and changes.drop == ["gone"]
    assert merged["id"].type == "bigint" and (merged["v"].length, merged["v"].decimal) == (7, 2)
    assert changes.nullable == ["v"] and changes.no_longer_unique == ["v"] and merged["more"].allow_null and merged["id"].primary
    gated = diff.apply_gates(old, changes, merged, CONFIG)
    assert gated["v"].unique and "gone" in gated and len(diff.blocked(changes, CONFIG)) == 2
    same, _ = diff.compare(old, old)
    assert not same.exist() and not diff.compare(None, new)[0].exist()
    assert "gone" not in diff.apply_gates(old, changes, merged, LoadConfig(delete_columns=True))


def test_shapes():
    assert not shape.too_wide(Header({"id": ColumnDef("int", primary=True), "name": ColumnDef("varchar", 255)}), LoadConfig(dialect="mysql"))
    assert shape.too_wide(Header({"t": ColumnDef("varchar", 16428)}), LoadConfig(dialect="mysql"))
    wide = Header({"id": ColumnDef("int", primary=True), **{f"c{i}": ColumnDef("varchar", 4000) for i in range(3)}})
    assert shape.too_wide(wide, CONFIG)
    parts = shape.split_parts("t", wide, {}, CONFIG)
    assert list(parts) == ["t__part_001", "t__part_002", "t__part_003"] and all("id" in p for p in parts.values())
    again = shape.split_parts("t", Header({**wide, "new": ColumnDef("int")}), parts, CONFIG)
    assert again["t__part_003"].keys() == {"id", "c2", "new"} and again["t__part_001"] == parts["t__part_001"]
    assert shape.next_table_name("t__part_009") == "t__part_010" and shape.true_name("a__history", CONFIG) == "a"
    stamped = shape.add_stamps(Header({"Created_At": ColumnDef("datetime")}))
    assert list(stamped) == ["Created_At", "dwh_modified_at", "dwh_loaded_at"]
    header = Header({"id": ColumnDef("int", primary=True), "customer_id": ColumnDef("int"), "region": ColumnDef("varchar", categorical=True), "revenue": ColumnDef("decimal"), "is_active": ColumnDef("boolean"), "created_at": ColumnDef("datetime"), "free_text": ColumnDef("varchar")})
    got = {s["column"]: s for s in shape.semantics(header, ["Customers"])}
    assert [s["hint"] for s in got.values()] == ["identifier", "identifier", "dimension", "measure", "flag", "time", "attribute"]
    assert got["customer_id"]["matched_table"] == "Customers" and got["id"]["references"] is None


def test_statements():
    assert ddl.quote_identifier("a`b") == "`a``b`"
    for bad in ("", "a\x00", "x" * 70):
        with pytest.raises(ValueError):
            ddl.quote_identifier(bad, CONFIG)
    one = ["SELECT 1", "SELECT 1;", "SELECT ';' -- ; x\n", "SELECT $$a;b$$;  /* ; */", "SELECT 'it''s; ok'"]
    many = ["SELECT 1; DROP TABLE x", "", ";", "SELECT 'a", "-- only a comment", "SELECT 1;;SELECT 2"]
    assert all(map(ddl.single_statement, one)) and not any(map(ddl.single_statement, many))
    with pytest.raises(ValueError):
        ddl.safe_default("1; DROP TABLE x")
    with pytest.raises(ValueError):
        ddl.safe_type("int); DROP")
    header = Header({"id": ColumnDef("int", primary=True), "n": ColumnDef("varchar", 9, allow_null=True, unique=True), "d": ColumnDef("date", index=True, default="x")})
    assert "PRIMARY KEY (`id`)" in ddl.create_table("t", header, CONFIG)[0] and "DEFAULT 'x'" in ddl.create_table("t", header, CONFIG)[0]
    assert len(constraint_name("t" * 80, "c").encode()) == 63


def test_config():
    for bad in ({"pseudo_unique": 0}, {"dialect": "x"}, {"thousands_separator": ","}, {"source_time_zone": "Mars/Base"}, {"surrogate_key": True, "add_history": True}, {"number_format_min_evidence": 0}, {"add_nested": True}):
        with pytest.raises(ValueError):
            LoadConfig(**bad)
    assert LoadConfig(number_format="EU").separators == (".", ",")


def test_row_sources(spark):
    assert is_rows([{"a": 1}]) and not is_rows([]) and not is_rows([[1]]) and column_union([{"a": 1}, {"b": 2, "a": 3}]) == ["a", "b"]
    df = from_rows(spark, [{"a": 1, "n": {"x": [1]}}, {"a": 2.5, "m": "t"}, {"m": True}])
    assert dict(df.dtypes) == {"a": "double", "n": "string", "m": "string"} and df.filter("m = 'true'").count() == 1
    closed = []

    def chunks():
        try:
            yield []
            yield [{"a": 1}]
            yield [{"a": 2}]
        finally:
            closed.append(True)

    source = frames(spark, chunks())
    assert next(source).count() == 1
    source.close()
    assert closed


def test_create_reload_and_widen(engine):
    e = engine()
    rows = [{"id": i, "active": i % 2 == 0, "name": f"n{i}", "amount": f"{i}.50", "event_date": "2024-01-15"} for i in range(5)]
    first = e.load("t", rows, ["id"])
    assert first.success, first.error
    assert (first.rows, first.inserted, first.updated) == (5, 5, 0)
    before, header = rows_of(e.read("t"), "*"), e.store.header("t")
    again = e.load("t", rows, ["id"])
    assert again.success and (again.inserted, again.updated) == (0, 5)
    assert rows_of(e.read("t"), "*") == before and e.store.header("t") == header
    assert dict(e.read("t").dtypes)["event_date"] == "date" and dict(e.read("t").dtypes)["active"] == "boolean"
    more = e.load("t", [{"id": 300, "active": "yes" == "no", "name": "a longer name", "amount": "12345.125", "event_date": "2024-02-01", "status": "new"}], ["id"])
    assert more.success, more.error
    types = dict(e.read("t").dtypes)
    assert types["id"] == "smallint" and types["amount"] == "decimal(8,3)" and "status" in types
    assert e.read("t").filter("status is null").count() == 5
    assert rows_of(e.read("t").filter("id = 300"), "name", "amount")[0][0] == "a longer name"


def test_preview_writes_nothing(engine):
    e = engine()
    p = e.preview("t", [{"id": 1, "v": "a"}], ["id"])[0]
    assert p.action == "create" and p.ddl and not e.store.exists("t")
    e.load("t", [{"id": 1, "v": "a"}], ["id"])
    assert e.preview("t", [{"id": 1, "v": "a"}], ["id"])[0].action == "noop"
    assert e.preview("t", [{"id": 1, "v": "abcdef", "w": 1}], ["id"])[0].action == "alter"


def test_history(engine):
    e = engine(add_history=True)
    e.load("t", [{"id": i, "val": i * 10} for i in (1, 2, 3)], ["id"])
    e.load("t", [{"id": 2, "val": 25}], ["id"], drop_unique_constraints=True)
    assert rows_of(e.read("t__history"), "id", "val") == [(2, 20)]
    e.load("t", [{"id": 2, "val": 25}], ["id"])
    assert rows_of(e.read("t__history"), "id", "val") == [(2, 20)] and rows_of(e.read("t"), "id", "val") == [(1, 10), (2, 25), (3, 30)]


def test_rejects(engine):
    e = engine(add_history=True, rejected_rows_table="bad", checks={"positive": "val >= 0"})
    assert e.load("t", [{"id": 1, "val": 10}, {"id": 2, "val": 10}], ["id"]).success
    r = e.load("t", [{"id": 1, "val": 15}, {"id": 2, "val": -5}], ["id"])
    assert r.success and r.rejected == 1
    assert rows_of(e.read("t"), "id", "val") == [(1, 15), (2, 10)] and rows_of(e.read("t__history"), "id", "val") == [(1, 10)]
    bad = e.read("bad").first()
    assert bad["target_table"] == "t" and json.loads(bad["raw_data"]) == {"id": "2", "val": "-5"} and "positive" in bad["error_message"]
    strict = engine(checks={"positive": "val >= 0"})
    failed = strict.load("t", [{"id": 1, "val": -1}], ["id"])
    assert not failed.success and failed.error_code == "rejected_rows" and rows_of(strict.read("t"), "id", "val") == [(1, 15), (2, 10)]


def test_unique_conflicts(engine):
    e = engine()
    e.load("t", [{"id": 1, "code": "A"}, {"id": 3, "code": "C"}], ["id"])
    r = e.load("t", [{"id": 2, "code": "A"}], ["id"])
    assert not r.success and r.error_code == "unique_conflict"
    r = e.load("t", [{"id": 2, "code": "A"}, {"id": 4, "code": "D"}], ["id"], rejected_rows_table="bad")
    assert r.success and r.rejected == 1 and rows_of(e.read("t"), "id") == [(1,), (3,), (4,)]
    r = e.load("t", [{"id": 2, "code": "A"}], ["id"], drop_unique_constraints=True)
    assert r.success and not e.store.header("t")["code"].unique


def test_duplicate_keys_and_modes(engine):
    e = engine()
    assert e.load("t", [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}, {"id": 1, "v": "c"}], ["id"]).success
    assert rows_of(e.read("t"), "id", "v") == [(1, "c"), (2, "b")]
    assert e.load("t", [{"id": 1, "v": "a"}, {"id": 1, "v": "b"}], ["id"], on_duplicate="error").error_code == "duplicate_key"
    assert e.load("t", [{"id": 1, "v": "z"}], ["id"], insert_type="INSERT").error_code == "duplicate_key"
    assert e.load("t", [{"id": 9, "v": "z"}], ["id"], insert_type="INSERT").success


def test_no_key_appends_and_surrogate(engine):
    rows = [{"region": "a", "bucket": 1, "tag": "x"}, {"region": "a", "bucket": 1, "tag": "x"}]
    e = engine()
    e.load("plain", rows)
    e.load("plain", rows)
    assert e.read("plain").count() == 4
    s = engine(surrogate_key=True)
    assert s.load("keyed", rows).success
    assert s.load("keyed", rows).success
    ids = [r[0] for r in s.read("keyed").select("_surrogate_id").collect()]
    assert len(ids) == 4 == len(set(ids))


def test_timestamps(engine):
    e = engine(add_timestamps=True)
    assert e.load("t", [{"id": 1, "v": "a"}], ["id"]).success
    one = e.read("t").first()
    time.sleep(0.01)
    assert e.load("t", [{"id": 1, "v": "b"}], ["id"], drop_unique_constraints=True).success
    two = e.read("t").first()
    assert one["dwh_created_at"] == two["dwh_created_at"] and two["dwh_modified_at"] > one["dwh_modified_at"] and two["v"] == "b"


def test_nested_tables(engine):
    e = engine(add_nested=True, nested_tables=("orders_lines",))
    rows = [{"id": 1, "lines": [{"sku": "a", "n": 1}, {"sku": "b", "n": 2}]}, {"id": 2, "lines": [{"sku": "c", "n": 3}]}]
    r = e.load("orders", rows, ["id"])
    assert r.success, r.error
    assert r.tables == ["orders", "orders_lines"] and "lines" not in e.read("orders").columns
    assert rows_of(e.read("orders_lines"), "id", "sku", "n") == [(1, "a", 1), (1, "b", 2), (2, "c", 3)]


def test_split_tables(engine):
    e = engine(auto_split=True)
    rows = [{"id": i, **{f"c{j}": f"{i}" * 900 for j in range(12)}} for i in range(1, 3)]
    r = e.load("wide", rows, ["id"])
    assert r.success and len(r.tables) > 1 and all("id" in e.read(t).columns for t in r.tables)
    assert e.load("wide", rows, ["id"]).tables == r.tables and all(e.read(t).count() == 2 for t in r.tables)


def test_extract_nested(spark):
    df = spark.createDataFrame([(1, '{"id": 7, "a": 1}'), (2, None)], "id int, j string")
    child = reshape.extract_nested(reshape.parse_json_column(df, "j"), "j", ["id"])
    assert [tuple(r) for r in child.select("id", "a").collect()] == [(1, 1)]
    assert reshape.extract_nested(df, "j", ["id"]) is None


def test_chunks(engine):
    e = engine()
    r = e.load_chunks("t", ([{"id": i, "name": f"n{i % 7}"} for i in range(a, a + 50)] for a in (100, 150, 200)), ["id"])
    assert r.success and r.rows == 150 and e.read("t").count() == 150 and dict(e.read("t").dtypes)["id"] == "smallint"


def test_stream_session(engine):
    e = engine()
    s = e.open_stream("t", ["id"])
    s.write([{"id": 1, "qty": 0, "note": {"a": [1]}}])
    s.write([])
    s.write([{"id": 2, "qty": 1}, {"id": 3, "qty": 200}])
    with pytest.raises(LoadError):
        s.write([{"other": 1}])
    assert s.end().success and rows_of(e.read("t"), "id", "qty", "note") == sorted([(1, 0, '{"a":[1]}'), (2, 1, None), (3, 200, None)], key=str)
    with pytest.raises(LoadError):
        s.write([{"id": 1}])
    dropped = e.open_stream("t", ["id"])
    dropped.write([{"id": 99, "qty": 1, "note": None}])
    dropped.abort()
    assert e.read("t").count() == 3 and not [n for n in e.store.files.names(e.store.path) if n.startswith("_stream__")]


def test_replayed_batches_are_skipped(engine, spark, tmp_path):
    e = engine()
    load = batch_loader(e, "s", "t")
    df = spark.createDataFrame([(1, "a"), (1, "a")], "x int, y string")
    for batch in (0, 1, 1, 0):
        load(df, batch)
    assert e.read("t").count() == 4
    source = f"{tmp_path}/in"
    spark.createDataFrame([(5, "b"), (6, "c")], "x int, y string").write.parquet(f"file://{source}")
    stream = spark.readStream.schema("x int, y string").parquet(f"file://{source}")
    load_stream(e, stream, "files", "u", f"file://{tmp_path}/cp", ["x"]).trigger(availableNow=True).start().awaitTermination(60)
    assert rows_of(e.read("u"), "x", "y") == [(5, "b"), (6, "c")]


def test_schema_history_drift_and_audit(engine):
    e = engine(schema_history=True, run_audit=True)
    start = time.time()
    assert e.load("t", [{"id": 1, "v": "a"}], ["id"]).success
    middle = time.time()
    assert e.load("t", [{"id": 2, "v": "b", "w": 5}], ["id"]).success
    events = e.catalog.events("t")
    assert [(x["version"], x["status"]) for x in events] == [(1, "applied"), (2, "applied")]
    assert e.catalog.schema_at("t", start - 1) is None and list(e.catalog.schema_at("t", middle)) == ["id", "v"] and "w" in e.catalog.schema_at("t", time.time())
    assert e.catalog.history_frame("t").count() == 2 and e.catalog.runs_frame().filter("success").count() == 2
    changed = e.store.header("t")
    changed.change("v", length=999)
    e.store.commit({"t": (None, changed)})
    assert e.catalog.check_drift("t", e.store.header("t"))
    strict = engine(schema_history=True, strict_drift_detection=True)
    with pytest.raises(SchemaDriftError):
        strict.catalog.check_drift("t", e.store.header("t"))
    assert strict.load("t", [{"id": 3, "v": "c", "w": 1}], ["id"]).error_code == "schema_drift"


def test_lock(engine):
    e = engine(use_schema_lock=True, schema_lock_timeout=0.2)
    with e.store.files.lock(f"{e.store.path}/_locks/t.lock", 1):
        assert e.load("t", [{"id": 1}], ["id"]).error_code == SchemaLockTimeoutError.code
    assert e.load("t", [{"id": 1}], ["id"]).success


def test_safe_mode_keeps_the_schema(engine):
    e = engine()
    e.load("t", [{"id": 1, "v": "a"}], ["id"])
    r = e.load("t", [{"id": 2, "v": "b", "w": 1}], ["id"], safe_mode=True)
    assert r.success and r.warnings and "w" not in e.read("t").columns and e.read("t").count() == 2


def test_failed_load_changes_nothing(engine):
    e = engine()
    e.load("t", [{"id": 1, "v": 1}], ["id"])
    before = e.store.manifest()
    assert not e.load("t", [{"id": 2, "v": 1}], ["id"], checks={"broken": "no_such_column > 1"}).success
    assert e.store.manifest() == before


def test_source_zone(engine):
    e = engine(source_time_zone="America/New_York")
    e.load("t", [{"id": 1, "ts": "2024-01-15 12:00:00"}, {"id": 2, "ts": "2024-07-15 12:00:00"}], ["id"])
    assert [r[1].hour for r in rows_of(e.read("t"), "id", "ts")] == [17, 16]


def test_upsert_keeps_protected_columns(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, v string, made int")
    staged = spark.createDataFrame([(2, "B", 99), (3, "C", 30)], "id int, v string, made int")
    assert rows_of(merge.upsert(target, staged, ["id"], keep=["made"]), "*") == [(1, "a", 10), (2, "B", 20), (3, "C", 30)]
    part = staged.select("id", "v")
    assert sorted(map(tuple, merge.upsert(target, part, ["id"]).collect()), key=str) == sorted([(1, "a", 10), (2, "B", 20), (3, "C", None)], key=str)


def test_merge_of_null_keys(spark):
    target = spark.createDataFrame([(None, "a"), (1, "b")], "id int, v string")
    staged = spark.createDataFrame([(None, "z")], "id int, v string")
    assert merge.upsert(target, staged, ["id"]).count() == 2 and merge.before_image(target, staged, ["id"], ["v"]).collect()[0]["v"] == "a"


def test_numbering(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("x")).repartition(5)
    got = merge.number_new_rows(df, "n", 5, [F.col("x")]).collect()
    assert all(r["n"] == r["x"] + 5 for r in got)


def test_interleaved_loads_keep_both(engine):
    """A load that another one overtakes between plan and commit is done again on top of it."""
    e = engine()
    assert e.load("t", [{"id": i, "v": "a"} for i in range(4)], ["id"]).success
    other, apply, calls = engine(), e._apply, []

    def overtaken(*args):
        if not calls:
            calls.append(other.load("t", [{"id": 1, "v": "b"}, {"id": 10, "v": "b"}]))
        return apply(*args)

    e._apply = overtaken
    r = e.load("t", [{"id": 2, "v": "c"}, {"id": 11, "v": "c"}])
    assert calls[0].success and r.success and (r.inserted, r.updated) == (1, 1)
    assert rows_of(e.read("t"), "id", "v") == [(0, "a"), (1, "b"), (2, "c"), (3, "a"), (10, "b"), (11, "c")]
    calls.clear()
    e.config = e.config.with_(max_retries=1)
    r = e.load("t", [{"id": 3, "v": "d"}])
    assert not r.success and r.error_code == "concurrent_load"
    assert rows_of(e.read("t"), "id", "v")[3] == (3, "a") and calls[0].success


def test_two_creations_of_one_table(engine):
    e, other = engine(), engine()
    apply, calls = e._apply, []

    def overtaken(*args):
        if not calls:
            calls.append(other.load("t", [{"id": 1, "v": "b"}], ["id"]))
        return apply(*args)

    e._apply = overtaken
    assert e.load("t", [{"id": 2, "v": "c"}], ["id"]).success and calls[0].success
    assert rows_of(e.read("t"), "id", "v") == [(1, "b"), (2, "c")]


def test_only_touched_files_are_written_again(engine):
    e = engine()
    for start in (0, 100, 200):
        assert e.load("t", [{"id": i, "v": "a"} for i in range(start, start + 100)], ["id"]).success
    before = set(e.store.parquet_files("t"))
    r = e.load("t", [{"id": 150, "v": "b"}, {"id": 999, "v": "b"}])
    assert r.success and (r.inserted, r.updated) == (1, 1)
    after = set(e.store.parquet_files("t"))
    held = {f.rsplit("/", 1)[1] for f in before - after}
    assert len(before - after) == 1 and len(before) > 3, held
    assert e.read("t").count() == 301 and e.read("t").filter("v = 'b'").count() == 2
    assert e.load("t", [{"id": 5000, "v": "c"}]).success and after <= set(e.store.parquet_files("t"))


def test_lock_of_a_live_holder_stays(engine, tmp_path):
    files, path = engine().store.files, f"file://{tmp_path}/x.lock"
    with files.lock(path, 1, stale=0.8):
        time.sleep(1.5)  # the holder renews it
        with pytest.raises(SchemaLockTimeoutError), files.lock(path, 0.3, stale=0.8):
            pass
    assert not files.exists(path)
    files.create(path, f"gone {time.time() - 100}")
    with files.lock(path, 1, stale=0.8):
        files.replace(path, f"another {time.time()}")
    assert files.read(path).startswith("another")  # a holder removes no lock but its own


def test_refused_rows_widen_the_table(engine):
    """Rows that a declared column does not fit: it is widened for those it can hold, checks refuse the rest."""
    said = {"id": ColumnDef("int", primary=True), "v": ColumnDef("tinyint", 3), "t": ColumnDef("varchar", 2), "w": ColumnDef("int", 5)}
    rows = [{"id": 1, "v": "5", "t": "ab", "w": "1"}, {"id": 2, "v": "70000", "t": "abcdef", "w": "2"}, {"id": 3, "v": "6", "t": "x", "w": "-3"}]
    e = engine(rejected_rows_table="rejects", checks={"w_positive": "w > 0"})
    r = e.load("t", rows, assume=said)
    assert r.success and (r.rows, r.inserted, r.rejected) == (3, 2, 1) and any("widened" in w for w in r.warnings)
    h = e.store.header("t")
    assert (h["v"].type, h["t"].length, h["w"].type) == ("int", 6, "int")
    assert rows_of(e.read("t"), "id", "v", "t") == [(1, 5, "ab"), (2, 70000, "abcdef")]
    e = engine(rejected_rows_table="rejects", max_retries=1)
    assert e.load("once", rows, assume=said).rejected == 1 and e.store.header("once")["v"].type == "tinyint"
    e = engine(rejected_rows_table="rejects", safe_mode=True)
    assert e.load("safe", rows, assume=said).rejected == 1


def test_composite_unique_constraints(engine):
    said = {"id": ColumnDef("int", primary=True), "a": ColumnDef("int", unique=True, unique_name="ab"), "b": ColumnDef("int", unique=True, unique_name="ab"), "c": ColumnDef("varchar", 9)}
    e = engine(auto_indexing=False)
    assert e.load("t", [{"id": i, "a": i // 2, "b": i % 2, "c": "x"} for i in range(6)], assume=said).success
    assert e.store.header("t").unique_groups == [["a", "b"]]
    assert e.load("t", [{"id": 7, "a": 0, "b": 9, "c": "y"}], assume=said).success  # one of the two is there already
    r = e.load("t", [{"id": 8, "a": 0, "b": 1, "c": "y"}, {"id": 1, "a": 0, "b": 1, "c": "own"}], assume=said)
    assert not r.success and r.error_code == "unique_conflict" and "1 conflicts on a,b" in r.error
    e = engine(auto_indexing=False, rejected_rows_table="rejects")
    r = e.load("t", [{"id": 8, "a": 0, "b": 1, "c": "y"}, {"id": 1, "a": 0, "b": 1, "c": "own"}], assume=said)
    assert r.success and r.rejected == 1 and ("own",) in rows_of(e.read("t"), "c")


def test_conflicts_are_counted_as_pairs(spark):
    target = [(i, i % 3 if i % 7 else None, i % 2) for i in range(40)]
    staged = [(i + 5, i % 4 if i % 5 else None, i % 2) for i in range(30)] + [(None, 1, 1)]
    t, s = (spark.createDataFrame(rows, "k long, u long, w long") for rows in (target, staged))
    got = {r[0]: r[1] for r in merge.unique_conflicts(t, s, ["k"], [["u"], ["u", "w"], ["k"]]).collect()}
    pairs = [(a, b) for a in target for b in staged if a[0] != b[0]]
    assert got == {"u": sum(a[1] == b[1] is not None for a, b in pairs), "u,w": sum(a[1] == b[1] is not None and a[2] == b[2] for a, b in pairs), "k": 0}
    refused = sorted(r[0] for r in merge.conflicting_rows(t, s, ["k"], ["u", "w"]).collect() if r[0] is not None)
    assert refused == sorted({b[0] for a, b in pairs if b[0] is not None and a[1] == b[1] is not None and a[2] == b[2]})


def test_sampling(spark):
    """Types, lengths and uniqueness are of all rows, other flags of the sample."""
    rows = [{"id": i, "near": i if i != 1999 else 0, "kind": f"k{i % 5}", "wide": 1 if i < 1999 else 70_000, "text": "x" * (1 + (i == 1999) * 50)} for i in range(2000)]
    h = infer(spark, rows, LoadConfig(sampling=0.05, sampling_minimum=100))
    assert (h["id"].unique, h["near"].unique, h["near"].pseudounique, h["kind"].categorical) == (True, False, True, True)
    assert (h["wide"].type, h["text"].length) == ("int", 51) and h.primary_keys == ["id"]
    assert infer(spark, rows[:50], LoadConfig(sampling=0.5, sampling_minimum=100)) == infer(spark, rows[:50])


def test_settings_without_effect_are_named(engine):
    said = []
    engine(insert_stack=5, logger={"warn": said.append})
    assert len(said) == 1 and "insert_stack" in said[0]


def test_databases_over_jdbc(spark):
    """Round trip through a database that comes with Spark: a table in parts, and a query."""
    url, driver = "jdbc:derby:memory:lakeloom;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(50).select(F.col("id").cast("int").alias("K"), F.concat(F.lit("v"), "id").alias("V"))
    write_jdbc(df, url, "T", "overwrite", **driver)
    write_jdbc(df.withColumn("K", F.col("K") + 50), url, "T", **driver)
    whole = read_jdbc(spark, url, "T", ("K", 0, 100, 4), **driver)
    assert whole.rdd.getNumPartitions() == 4 and rows_of(whole, "K", "V") == sorted((i, f"v{i % 50}") for i in range(100))
    assert rows_of(read_jdbc(spark, url, "SELECT K FROM T WHERE K >= 97", **driver), "K") == [(97,), (98,), (99,)]
    with pytest.raises(ValueError):
        read_jdbc(spark, url, "SELECT 1; DROP TABLE T", **driver)


def test_type_groups():
    assert [t for t in ts.ALL_TYPES if ts.is_integer(t)] == ["tinyint", "smallint", "int", "bigint"]
    assert [t for t in ts.ALL_TYPES if ts.is_floating(t)] == ["numeric", "decimal", "double", "exponent"]
    assert not ts.is_numeric("boolean") and not ts.is_numeric("binary") and ts.is_numeric("numeric") and not ts.is_date("timestamp")


def test_one_of_many_creates_a_file(engine, tmp_path):
    files, gate = engine().store.files, threading.Barrier(8)

    def create(path):
        gate.wait()
        return files.create(path, "x")

    with ThreadPoolExecutor(8) as pool:
        made = [sum(pool.map(create, [f"file://{tmp_path}/new/{i}.lock"] * 8)) for i in range(100)]
    assert made == [1] * 100


def test_readers_see_a_whole_file_while_it_is_replaced(engine, tmp_path):
    files, path = engine().store.files, f"file://{tmp_path}/m.json"
    files.replace(path, "0" * 2000)
    with ThreadPoolExecutor(1) as pool:
        writer = pool.submit(lambda: [files.replace(path, str(i % 10) * 2000) for i in range(50)])
        while not writer.done():
            text = files.read(path)
            assert text is not None and len(text) == 2000 and len(set(text)) == 1
        writer.result()
    assert files.read(path) == "9" * 2000 and files.names(f"file://{tmp_path}") == ["m.json"]


def test_replacing_a_file_that_has_a_checksum(spark, engine, tmp_path):
    """One written through Spark's file system classes, as earlier stores were."""
    files, path = engine().store.files, f"file://{tmp_path}/m.json"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(b"old"))
    stream.close()
    assert (tmp_path / ".m.json.crc").exists() and not files.create(path, "other") and files.read(path) == "old"
    files.replace(path, "new one")
    assert files.read(path) == "new one"


def test_merge_reads_a_written_batch(engine, monkeypatch):
    seen = []
    upsert = merge.upsert
    monkeypatch.setattr(merge, "upsert", lambda target, staged, *rest: seen.append(staged) or upsert(target, staged, *rest))
    e = engine()
    for v in (1, 2):
        assert e.load("t", [{"id": i, "v": v} for i in range(3)], ["id"]).success
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and rows_of(e.read("t"), "id", "v") == [(i, 2) for i in range(3)]


def test_refused_plan_keeps_its_profile(engine, monkeypatch):
    from lakeloom import engine as module
    from lakeloom.errors import ConcurrentLoadError

    e, calls, refused = engine(), [], []
    infer_header, commit = module.infer_header, e.store.commit
    monkeypatch.setattr(module, "infer_header", lambda *a, **k: calls.append(1) or infer_header(*a, **k))

    def once(*args, **options):
        if not refused:
            refused.append(1)
            raise ConcurrentLoadError("meanwhile")
        commit(*args, **options)

    monkeypatch.setattr(e.store, "commit", once)
    assert e.load("t", [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}], ["id"]).success and len(calls) == 1
    assert rows_of(e.read("t"), "id", "v") == [(1, "a"), (2, "b")]


def test_overlapping_settings_are_restored(spark):
    from lakeloom.sources.scratch import setting

    key = "spark.sql.codegen.hugeMethodLimit"
    before, one, two = spark.conf.get(key), setting(spark, key, "8000"), setting(spark, key, "8000")
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    two.__exit__(None, None, None)
    assert spark.conf.get(key) == before
