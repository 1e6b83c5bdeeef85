"""The corpus pipeline stage by stage against brute force, on rows with nulls, repeats and columns of every name in use."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from tidemark.llm import jaccard, mixing, queries, secrets
from tidemark.session import scratch_path

EXTRA = ["row_key", "__row_key", "__spans", "__h", "__source", "__run", "phase", "key", "score", "lang_pred", "kind", "c0", "own_3"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
SYLLABLES = {"en": ["the", "ing", "and", "wh", "ed"], "de": ["sch", "ung", "keit", "ü", "ver"], "es": ["ción", "os", "la", "que", "ñ"]}


def _rows():
    pick = random.Random(12)

    def said(lang, count):
        return " ".join("".join(pick.choice(SYLLABLES[lang]) for _ in range(pick.randint(1, 4))) for _ in range(count))

    rows = [(i, said(lang := list(SYLLABLES)[i % 3], pick.randint(20, 90)), lang, "abc"[i % 2]) for i in range(240)]
    near = rows[0][1].split()
    rows += [(300 + i, " ".join([*near[:-1], f"word{i}"]), rows[0][2], "a") for i in range(12)]
    rows += [(400, rows[4][1], "de", "b"), (4, rows[4][1], "de", "b"), (None, rows[5][1], "es", None), (None, rows[7][1], "de", "c")]
    rows += [(500, rows[8][1] + " token=Zx9Kq2Lm8Wv4Tn7Rb1Yc5 " + rows[11][1], "es", "a"), (501, "12 34!", "en", "a"), (502, None, "en", "b"),
             (503, "", None, None), (504, said("en", 9000), "en", "a")]
    return [(*r, len(r[1] or ""), *(f"{c}{i}" for c in EXTRA)) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    root = scratch_path(spark, "pipeline")
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    docs, out = spark.read.parquet(f"{root}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        made, path = stage(spark, docs, root), scratch_path(spark, "stage")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, made.columns, before, [tuple(r) for r in docs.collect()]))
    return root, out


def test_all_but_the_last_stage_keep_the_columns(stages):
    wanted = [c.strip().split()[0].strip("`") for c in SCHEMA.split(",")]
    assert [columns for _, columns, _, _ in stages[1][:-1]] == [wanted] * 4
    assert [name for name, *_ in stages[1]] == [name for name, _ in corpus_pipeline.STAGES]


def test_language_stage_rejects_what_has_no_language(stages):
    _, _, before, after = stages[1][0]
    gone = Counter(before) - Counter(after)
    assert not Counter(after) - Counter(before)
    assert {501, 502, 503} <= {r[0] for r in gone} and sum(gone.values()) <= 3 + 0.03 * len(before)


def test_jaccard_stage_keeps_one_of_each_group(stages):
    _, _, before, after = stages[1][1]

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, group = [shingles(r[1]) for r in before], list(range(len(before)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    members = {}
    for i, row in enumerate(before):
        members.setdefault(root(i), []).append((row[0] is None, row[0] or 0, row[1]))
    assert Counter((r[0] is None, r[0] or 0, r[1]) for r in after) == Counter(min(m) for m in members.values())
    assert not Counter(after) - Counter(before)


def test_secret_stage_changes_texts_only(stages):
    _, _, before, after = stages[1][2]

    def clean(text):
        return re.sub(r"token=\S+", secrets_mark, text)

    secrets_mark = "[SECRET]"
    assert Counter((r[0], clean(r[1]), *r[2:]) for r in before) == Counter(after)
    assert sum(secrets_mark in r[1] for r in after) == 1


def test_mixing_stage_keeps_every_row(stages):
    _, _, before, after = stages[1][3]
    assert Counter(before) == Counter(after)


def test_encoding_stage_is_that_of_the_library(stages):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    _, columns, before, after = stages[1][4]
    want = []
    for row in before:
        ids = library.encode(row[1], add_special_tokens=False).ids
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r[columns.index(c)] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in after]
    assert Counter(got) == Counter(want)


def test_tokens_follow_the_order_of_the_mix(spark, stages):
    _, _, before, _ = stages[1][3]
    docs = spark.createDataFrame(before, SCHEMA).selectExpr("doc_id", "sha1(text) AS text", "source")  # texts are mixed by their digest
    mixed = mixing.mixed(docs).orderBy("position").select("doc_id").collect()
    columns, rows = stages[1][4][1], stages[1][4][3]
    got = sorted(tuple(r[columns.index(c)] for c in ("position", "offset", "n_tokens", "doc_id")) for r in rows)
    assert [r[0] for r in got] == list(range(len(before)))
    assert [r[3] for r in got] == [r["doc_id"] for r in mixed]
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]


def test_places_are_those_of_the_files(spark):
    path = scratch_path(spark, "files")
    spark.range(300).selectExpr("299 - id AS doc_id", "id % 7 AS size").repartitionByRange(13, "doc_id").sortWithinPartitions(
        "doc_id").write.parquet(path)
    rows = mixing.placed(mixing.located(spark.read.parquet(path)), "size").collect()
    assert rows[0].asDict().keys() == {"doc_id", "size", "position", "offset"} and all(r["position"] == r["doc_id"] for r in rows)
    sizes = [r["size"] for r in sorted(rows)]
    assert [r["offset"] for r in sorted(rows)] == [sum(sizes[:i]) for i in range(300)]


def test_run_is_its_stages(spark, stages):
    root, out = stages
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, root).collect()) == Counter(out[-1][3])


def test_an_empty_table(spark):
    root = scratch_path(spark, "pipeline")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/documents.parquet")
    assert corpus_pipeline.run(spark, root).collect() == []


def test_operators_keep_columns_named_as_their_own(spark):
    docs = spark.createDataFrame(_rows()[:40], SCHEMA)
    for kept in (jaccard.keep_one(docs), secrets.redact(docs)):
        rows = {r["doc_id"]: r for r in kept.collect()}
        assert all(rows[i][c] == f"{c}{i}" for i in rows for c in EXTRA)
