"""Phrase mining against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import phrases

SCHEMA = "doc_id long, text string, lang string, p string, f long, id string, word int, rank string, n long"
LEAST = 6


def _rows():
    pick = random.Random(6)
    vocabulary = ["the", "Of", "new", "york", "city", "é", "Ümlaut", "x" * 300, "a-b", "it's", "new", "york", "hall"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(160):
        said = []
        for _ in range(pick.randint(0, 40)):
            said.append(pick.choice(["New York", "city hall of records", pick.choice(vocabulary), pick.choice(vocabulary)]))
            said.append(pick.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "; "]))
        rows.append((i, "".join(said), pick.choice(["en", "fr", None, "und"])))
    rows += [(i, rows[7][1], "en") for i in range(300, 310)] + [(7, rows[7][1], "en"), (None, rows[9][1], "en")]
    rows += [(400, None, "en"), (401, "", None), (402, " \t.,", "fr"), (403, "one", "xx"), (404, "a a " * 3000, "en"), (405, "b c d " * 20, "de")]
    return rows


def _brute(rows, least, top, percent=80):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        own = counts.setdefault(lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in counts.items():
        found = []
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in frequent.items():
            if any(100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in frequent.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out, key=repr)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "i", 2, "r", 3) for r in rows], SCHEMA)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("top", [7, 2000])
def test_phrases_are_those_of_brute_force(spark, top):
    rows = _rows()
    got = phrases.collocations(_frame(spark, rows).repartition(4), LEAST, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = _brute(rows, LEAST, top)
    assert _got(got) == want and len(want) > 20


def test_small_groups_change_no_row(spark, monkeypatch):
    """Many groups, and cells whose suffixes are dealt by their following words."""
    monkeypatch.setattr(phrases, "GROUP_SUFFIXES", 50)
    rows = _rows()
    assert _got(phrases.collocations(_frame(spark, rows).repartition(3), LEAST)) == _brute(rows, LEAST, 2000)


def test_large_numbers_stay_exact(spark, monkeypatch):
    big = 3 * 10**15
    rows = spark.createDataFrame([(1, "en", "a", big), (2, "en", "b", big + 1), (None, "en", None, 9 * 10**18)], "id long, lang string, word string, f long")
    counts = spark.createDataFrame([([1], big), ([2], big + 1), ([1, 2], big - 1)], "p array<long>, f long")
    monkeypatch.setattr(phrases, "counted", lambda df, least: (rows, counts))
    assert _got(phrases.collocations(rows)) == [("en", 1, "a b", big - 1, big, big + 1, 9 * 10**18, 2_000_000 * (big - 1) // (2 * big + 1))]


def test_empty_table(spark):
    assert phrases.collocations(_frame(spark, [])).collect() == []
    assert phrases.collocations(_frame(spark, [(1, None, None), (2, "", "en")])).collect() == []


@pytest.mark.parametrize("chunk", [40, 1 << 18])
def test_words_and_pieces_of_texts_in_chunks(monkeypatch, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    texts = [(r[1] or "").encode() for r in _rows()]
    got = [[] for _ in texts]
    for data, number, piece, text, start, end in phrases._words_of(texts, np.zeros(len(texts), np.uint64)):
        for n, p, t, a, b in zip(number.tolist(), piece.tolist(), text.tolist(), start.tolist(), end.tolist(), strict=True):
            got[t].append((data[a:b].lower(), p, n))
    numbers = {}
    for text, words in zip(texts, got, strict=True):
        pieces = [re.findall(rb"[^\x20\x09]+", p) for p in re.split(rb"[.,;:!?\x0A-\x0D]", text.lower())]
        assert [w for w, _, _ in words] == [w for p in pieces for w in p]
        together = {}
        for w, p, n in words:
            together.setdefault(p, []).append(w)
            assert numbers.setdefault(w, n) == n
        assert list(together.values()) == [p for p in pieces if p]
    assert len(set(numbers.values())) == len(numbers)


def test_filter_agrees_with_its_lookup(spark):
    pick = np.random.default_rng(1)
    numbers = pick.integers(-(1 << 63), 1 << 63, 500)
    bits = phrases._filter_of(spark.createDataFrame(pa.table({"number": numbers})))
    assert phrases._in_filter(bits, numbers.view(np.uint64)).all()
    others = pick.integers(-(1 << 63), 1 << 63, 2000).view(np.uint64)
    assert phrases._in_filter(bits, others).mean() < 0.01
