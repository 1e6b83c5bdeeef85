from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import infer
from tidemark.sources import pages


def test_unwrap_takes_the_first_key_that_is_a_list(spark):
    bodies = ['[{"i": 1}, {"i": 2}]', '{"data": {"i": 0}, "items": [{"i": 3}]}', '{"content": [{"i": 4}], "results": [{"i": 5}]}',
              '{"other": [{"i": 9}]}', '"text"', "not json", '{"data": []}']
    df = spark.createDataFrame(list(enumerate(bodies)), "page int, body string")
    got = pages.unwrap_envelope(df, "body").select("page", "position", F.variant_get("item", "$.i", "int").alias("i"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (2, 0, 5)]


def test_dotted_path(spark):
    bodies = ['{"pagination": {"next_cursor": "n1"}}', '{"pagination": "x"}', '{"pagination": {"next_cursor": null}}', "[1]", "{"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r[0] for r in df.select(pages.json_path(F.col("body"), "pagination.next_cursor")).collect()]
    assert got == ["n1", None, None, None, None]


def test_page_strategies(spark):
    df = spark.range(250)
    numbered = pages.page_slice(df, ["id"], 100).groupBy("page").count().orderBy("page").collect()
    assert [tuple(r) for r in numbered] == [(1, 100), (2, 100), (3, 50)]
    offsets = pages.page_slice(df, ["id"], 100, "offset_limit").select("offset").distinct().orderBy("offset").collect()
    assert [r[0] for r in offsets] == [0, 100, 200]
    assert pages.page_slice(df, ["id"], 100, "none").select("page").distinct().count() == 1


def test_audit_finds_gaps_late_pages_and_copies(spark):
    items = [("ok", 1, 1), ("ok", 1, 2), ("ok", 2, 3), ("bad", 1, 1), ("bad", 1, 2), ("bad", 3, 3), ("bad", 4, 3), ("bad", 4, 4),
             ("empty", 1, 1), ("empty", 1, 2), ("empty", 2, None), ("open", 1, 1), ("open", 1, 2)]
    audit = {r.resource: r for r in pages.pagination_audit(
        spark.createDataFrame(items, "resource string, page int, item_id int"), 2).collect()}
    assert audit["ok"].clean and audit["empty"].clean and audit["empty"].pages == 2
    bad = audit["bad"]
    assert (bad.end_page, bad.missing_pages, bad.pages_after_end, bad.duplicate_items, bad.clean) == (3, 1, 1, 1, False)
    assert audit["open"].end_page is None and not audit["open"].clean


def test_cursor_chains(spark):
    rows = [("long", None if i == 0 else f"c{i}", f"c{i + 1}" if i < 99 else None) for i in range(100)]
    rows += [("copy", None, "a"), ("copy", None, "a"), ("copy", "a", "")]
    rows += [("gap", None, "a"), ("gap", "b", "c"), ("gap", "c", None)]
    rows += [("ring", None, "a"), ("ring", "a", "b"), ("ring", "b", "a")]
    rows += [("branch", None, "x"), ("branch", "stray", "x"), ("branch", "x", None)]
    got = {(r.resource, r.cursor): (r.position, r.status) for r in pages.cursor_chain(
        spark.createDataFrame(rows, "resource string, cursor string, next_cursor string")).collect()}
    assert all(got["long", None if i == 0 else f"c{i}"] == (i, "ok") for i in range(100))
    assert got["copy", None] == (0, "ok") and got["copy", "a"] == (1, "ok")
    assert got["gap", None] == (0, "dangling") and got["gap", "b"] == (None, "unreachable")
    assert got["ring", "a"] == (1, "ok") and got["ring", "b"] == (2, "ok")
    assert got["branch", "x"] == (1, "ok") and got["branch", "stray"] == (None, "unreachable")


def test_inferred_fields(spark):
    docs = ['{"_id": 1, "a": 1, "b": "x", "n": null, "m": 1}', '{"a": 2, "b": 2.5, "c": [1], "d": {"e": 1}, "m": null, "t": true}']
    df = spark.createDataFrame([("logs", d) for d in docs], "object string, body string")
    got = {r.name: r.normalized_type for r in infer.infer_json_fields(df, "body", "object").collect()}
    assert got == {"a": "integer", "b": "string", "n": "string", "m": "string", "c": "json", "d": "json", "t": "boolean"}


def test_unreadable_documents_are_counted_by_collection(spark):
    df = spark.createDataFrame([("a", "{"), ("a", '{"x": 1}'), ("a", None), ("b", "nope"), ("b", "[1"), ("c", "1")], "object string, body string")
    got = {r.object_id: (r.documents, r.unreadable) for r in infer.unreadable_documents(df, "body", "object").collect()}
    assert got == {"a": (3, 1), "b": (2, 2), "c": (1, 0)}


def test_whole_numbers_of_any_size_are_integers(spark):
    df = spark.createDataFrame([("o", '{"a": 12345678901234567890, "b": 2.0, "c": 1e3, "d": -7}')], "object string, body string")
    got = {r.name: r.normalized_type for r in infer.infer_json_fields(df, "body", "object").collect()}
    assert got == {"a": "integer", "b": "float", "c": "float", "d": "integer"}


def test_first_item_of_the_first_page(spark):
    pages_df = spark.createDataFrame([
        ("r", 2, '[{"x": 1}]'), ("r", 1, '{"data": "no", "items": [{"ID": 7, "name": "n", "v": 1.5, "k": null}, {"y": 1}]}'),
        ("single", 1, '{"id": 1}'), ("empty", 1, '{"items": []}')], "resource string, page int, body string")
    got = {(r.object_id, r.name): (r.normalized_type, r.is_primary_key)
           for r in infer.infer_first_item(pages_df, "body", "resource", "page").collect()}
    assert got == {("r", "ID"): ("integer", True), ("r", "name"): ("string", False), ("r", "v"): ("float", False),
                   ("r", "k"): ("string", False), ("single", "id"): ("integer", True)}


def test_declared_document_schema(spark):
    spec = ('{"required": ["name", "email"], "properties": {"name": {"bsonType": "string"}, "age": {"bsonType": ["null", "int"]}, '
            '"email": {"bsonType": "string"}, "at": {"bsonType": "date"}, "raw": {}, "odd": {"bsonType": "regex"}}}')
    df = spark.createDataFrame([("users", spec)], "object string, spec string")
    got = {r.name: (r.source_type, r.normalized_type, r.nullable) for r in infer.fields_from_json_schema(df, "spec", "object").collect()}
    assert got == {"name": ("bson:string", "string", False), "age": ("bson:int", "integer", True),
                   "email": ("bson:string", "string", False), "at": ("bson:date", "timestamp", True),
                   "raw": ("bson:string", "string", True), "odd": ("bson:regex", "string", True)}
