"""Operators over pages and embeddings against brute force and planted damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_module
import io
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hnsw, multiindex, pathratio, warc
from tidemark.llm.components import components
from tidemark.session import cut

PAGES = [(3, "http://a/3", "<p>one</p>"), (1, "http://a/1", "<p>one</p>"), (2, None, "<p>é</p>"), (2, "http://a 2\n", "<p>é</p>"), (4, "u", None),
         (5, "u", ""), (None, "u", "<p>one</p>"), (None, "n", "only null"), (6, "u", "long " * 50_000), (7, "x", "WARC/1.1\r\n\r\n"), (8, "y", "8")]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, path string, bytes int")


def _bare(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_archives_give_back_every_page(spark):
    got = warc.round_trip(_pages(spark, PAGES)).collect()
    seen, want = set(), []
    for page_id, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        first = min((p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        kind = "revisit" if data in seen else "response"
        seen.add(data)
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first if kind == "revisit" else None))
    assert _bare(got) == _bare(want)
    assert warc.round_trip(_pages(spark, [])).count() == 0


def _file(data):
    return warc._File(io.BytesIO(data), len(data))


@pytest.fixture
def members():
    out = []
    for i in range(6):
        body = f"<p>{i}</p>".encode() * 50
        out.append(gzip.compress(warc.record(i, "u", body, len(body), warc._sha1(body), None)))
    return out


def _ids(found):
    return [x["record_id"] for _, _, x in found if isinstance(x, dict)]


def test_salvage_of_damaged_members(members):
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + b"junk\x1f\x8b\x08junk" + members[1] + bytes(broken) + members[3] + members[4] + members[5][:-9]
    found = list(warc.salvage(_file(data)))
    assert _ids(found) == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
    gaps = [(a, b) for a, b, x in found if isinstance(x, str)]
    one = len(members[0])
    two = one + 11 + len(members[1])
    three = two + len(broken)
    assert gaps == [(one, one + 11), (two, three), (three + len(members[3]) + len(members[4]), len(data))]
    # Records and gaps cover the file.
    assert sorted({(a, b) for a, b, _ in found})[0][0] == 0 and max(b for _, b, _ in found) == len(data)


def test_salvage_of_uncompressed_records(members):
    records = [gzip.decompress(m) for m in members]
    wrong = records[1].replace(b"<p>1</p>", b"<p>X</p>", 1)
    data = records[0] + wrong + records[2] + b"noise" + records[3]
    found = list(warc.salvage(_file(data)))
    assert _ids(found) == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    assert [x for *_, x in found if isinstance(x, str)] == ["block digest differs", "no member or version line"]
    inside = list(warc.salvage(_file(gzip.compress(records[0] + wrong + records[2]))))
    assert _ids(inside) == ["<urn:page:0>", "<urn:page:2>"]


@pytest.mark.parametrize("uri, plain", [
    ("s3a://bucket/a/b", "s3://bucket/a/b"), ("s3n://bucket/a", "s3://bucket/a"), ("dbfs:/tmp/x", "file:///dbfs/tmp/x"),
    ("dbfs:///tmp/x", "file:///dbfs/tmp/x"), ("file:/tmp/x", "file:///tmp/x"), ("file:///tmp/x", "file:///tmp/x"), ("/tmp/a:b", "/tmp/a:b"),
    ("hdfs://name:9000/x", "hdfs://name:9000/x"), ("gs://bucket/x", "gs://bucket/x")])
def test_names_of_shared_folders(uri, plain):
    assert warc.plain_uri(uri) == plain


def test_archives_below_a_folder_of_another_scheme(spark, tmp_path, monkeypatch):
    # The scheme's store is a local folder here; paths that are handed on keep the scheme.
    monkeypatch.setattr(warc, "_store", lambda uri: warc.pafs.FileSystem.from_uri(uri.replace("file:", "file://")))
    archives = warc.write_archives(_pages(spark, [(1, "u", "x"), (2, "u", "y")]).coalesce(1), f"file:{tmp_path}/w")
    assert all(r["path"].startswith(f"file:{tmp_path}") for r in archives.collect())
    assert warc.read_archives(archives).filter("fault IS NULL").count() == 2


def test_damage_on_disk_is_reported(spark, tmp_path):
    archives = warc.write_archives(_pages(spark, [(i, "u", f"page {i} " * 30) for i in range(20)]).coalesce(1), f"file://{tmp_path}/w")
    path = archives.orderBy("path").first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[40] ^= 0xFF
    with open(path, "wb") as file:
        file.write(data)
    rows = warc.read_archives(archives).collect()
    assert sum(r["fault"] is None for r in rows) == 19 and sum(r["fault"] is not None for r in rows) == 1
    assert all(r["payload"] for r in rows if r["fault"] is None)


ARTICLE = "<article><h1>Title</h1><p>First, a &amp; b.\n Second<b>bold</b> line.<p>Short.</p><ul><li>An item, here.</li></ul></article>"
PAGE = (
    "<html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site header</header>"
    "<nav><ul><li><a>Home</a></li></ul></nav><div class='ad'>Buy, buy, buy. Now, now!</div><div class=\"cookie-notice\">We use cookies, you know.</div>"
    + ARTICLE + "<form>Mail: <input></form><aside>Side, bar.</aside><div id='comments'><p>Great, great post. I agree, truly.</p></div>"
    "<footer>&copy; us</footer></body></html>")


def test_main_text_without_boilerplate():
    assert pathratio.main_text(PAGE) == "Title First, a & b. Secondbold line. Short. An item, here."
    plain = "<body><div class=menu>x</div><div><p>Some words, more words.</p><p>Again, words.</p></div><footer>f</footer>"
    assert pathratio.main_text(plain) == "Some words, more words. Again, words."


LONG = "This is a long paragraph, with several clauses; it goes on, and on, for a while. And then it ends."


def _plain_article(html):
    """A second version for pages with one ``article``: its blocks without markup, by regular expressions."""
    found = re.search(r"<article>(.*?)</article>", html or "", re.S)
    if not found:
        return None
    blocks = re.split(r"</?(?:p|h1|h2|ul|ol|li|div|table|tr|td|blockquote|pre|br)\b[^>]*>", found[1])
    texts = (html_module.unescape(re.sub(r"<!--.*?-->|<[^>]+>", "", b)) for b in blocks)
    return " ".join(filter(None, (" ".join(t.split()) for t in texts)))


@pytest.mark.parametrize("words", [pathratio.MARK_WORDS, frozenset()])
def test_given_pages_against_a_plain_version(sf_dir, monkeypatch, words):
    """Long articles need no word list; with every path called content, none keeps its text."""
    rows = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    monkeypatch.setattr(pathratio, "MARK_WORDS", words)
    wanted = {r["page_id"]: _plain_article(r["html"]) for r in rows}
    sized = [r for r in rows if wanted[r["page_id"]] is not None and (words or len(wanted[r["page_id"]]) > 200)]
    assert len(sized) > 10
    assert all(pathratio.main_text(r["html"]) == wanted[r["page_id"]] for r in sized)
    monkeypatch.setattr(pathratio, "content_paths", lambda blocks: {b[0] for b in blocks})
    assert all(pathratio.main_text(r["html"]) != wanted[r["page_id"]] for r in sized)


@pytest.mark.parametrize(("html", "text"), [
    # A classic server-side page lies in one form.
    (f"<body><form><h1>T</h1><p>{LONG}</p><input><button>Go</button><select><option>x</select><p>{LONG}</p></form></body>", f"T {LONG} {LONG}"),
    # An id is a place to link to, not a mark.
    (f'<article><h1>T</h1><p>{LONG}</p><section id="cookies"><p>{LONG}</p></section><h2 id="related-work">Related</h2><p>{LONG}</p></article>',
     f"T {LONG} {LONG} Related {LONG}"),
    # No article, no names: links and a short comment behind the text.
    (f'<div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div><a href="/">Home</a> <a href="/s">Shop</a></div><div>Tom wrote: nice!</div>',
     f"T {LONG} {LONG}"),
    # A list of links amid the text, a short list item, and a paragraph with a link in it.
    (f'<div><p>{LONG}</p><ul><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul><p>{LONG} <a href="/x">See there.</a></p>'
     f'<ul><li>One.</li></ul><p>{LONG}</p></div>', f"{LONG} {LONG} See there. One. {LONG}"),
    # Marked containers inside and outside of an article.
    (f'<div class="cookie-notice">We use cookies, gladly; and more, often.</div><article><p>{LONG}</p><div class="share">Share this, now.</div>'
     f'<p>{LONG}</p></article><div class="comments"><p>I agree, fully.</p></div><footer>Us, 2024.</footer>', f"{LONG} {LONG}"),
    # The site's name is a heading too.
    (f"<header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><div><h2>Head</h2><p>{LONG}</p></div><aside>More, here.</aside>", f"Head {LONG}"),
])
def test_pages_of_many_kinds(html, text):
    assert pathratio.main_text(html) == text


def test_a_strong_neighbour_lifts_no_weak_path():
    paths = pathratio.content_paths([("a.p", 500, 6, 0, 1.0), ("a.div", 6, 0, 0, 1.0), ("a.p", 500, 6, 0, 1.0), ("a.ul.li", 9, 0, 9, 1.0)])
    assert paths == {"a.p"}


@pytest.mark.parametrize("html", [None, "", "<nav>menu</nav>", "<script>x", "<!-- x", "<![if x]>", "<" * 500, "</p></div>"])
def test_odd_pages(html):
    assert isinstance(pathratio.main_text(html), str)


def test_no_content_outside_of_its_largest_part_is_lost():
    long = "Many words of text, one after the other, stand here. " * 20
    body = " ".join([long.strip()] * 3)
    nested = f"<body><article><h1>Title</h1><p>Lede.</p><div class=body>{f'<p>{long}</p>' * 3}</div></article><footer>f</footer></body>"
    assert pathratio.main_text(nested) == f"Title Lede. {body}"
    apart = f"<body><div class=menu>m</div><div><div><h1>Title</h1></div><div>{f'<p>{long}</p>' * 3}</div></div><div class=ad>x</div></body>"
    assert pathratio.main_text(apart) == f"Title {body}"
    for outer in ("article", "div"):
        split = (f"<body><nav>n</nav><{outer}><section>{f'<p>{long}</p>' * 6}</section><section><p>{long}</p></section></{outer}></body>")
        assert pathratio.main_text(split) == " ".join([long.strip()] * 7)
    # Content right below the root, outside of any element.
    assert pathratio.main_text(f"<div><p>{long}</p></div><div><p>{long}</p></div>") == " ".join([long.strip()] * 2)


def test_extraction_of_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "word, " * 60_000)]
    got = pathratio.extract(_pages(spark, rows)).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(pathratio.main_text(r[2])) for r in rows)
    assert pathratio.extract(_pages(spark, [])).count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, shard int, score double")


def _nearest(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and all(map(np.isfinite, v)) and any(v):
            fine[i, tuple(v)] = np.array(v, dtype=np.float32).astype(np.float64)
    out = set()
    for (i, q), x in fine.items():
        if i % every == 0:
            others = sorted((-round(math.fsum(a * b for a, b in zip(x.tolist(), y.tolist(), strict=True)), 12), j) for (j, w), y in fine.items() if j != i and len(w) == len(q))
            out |= {(i, rank, j, round(-s, 9)) for rank, (s, j) in enumerate(others[:k], 1)}
    return out


def test_nearest_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # one vector many times
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (None, rows[1][1]), (304, []), (305, [1.0, 2.0]),
             (320, [2.0, 1.0]), rows[5], rows[5], (306, [float("inf")] * 8)]
    got = {(*r[:3], round(r[3], 9)) for r in hnsw.nearest(_vectors(spark, rows), F.expr("vec_id % 20 = 0"), k=5).collect()}
    want = _nearest(rows, 5, 20)
    assert len(got & want) >= 0.95 * len(want) and len(got) == len(want)
    assert {r for r in got if r[0] == 200} == {r for r in want if r[0] == 200}
    assert hnsw.nearest(_vectors(spark, []), F.expr("vec_id % 20 = 0")).count() == 0
    assert hnsw.nearest(_vectors(spark, rows[:3]), F.expr("vec_id % 20 = 0"), k=20).count() == 2


def test_shards_and_recall(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 300)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(1200)]
    got = {(r[0], r[2]) for r in hnsw.nearest(_vectors(spark, rows), F.expr("vec_id % 20 = 0"), k=10).collect()}
    want = {(r[0], r[2]) for r in _nearest(rows, 10, 20)}
    assert len(got & want) >= 0.9 * len(want)


def test_sign_codes(spark):
    pick = np.random.default_rng(4)
    vectors = [pick.normal(size=n).astype("float32").tolist() for n in (1, 5, 64, 65, 200)] + [[], [0.0] * 70, [1.0, None, 2.0]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(99, None)], "i int, v array<float>")
    got = {r["i"]: r["code"] for r in rows.select("i", multiindex.sign_code(F.col("v")).alias("code")).collect()}
    for i, v in enumerate(vectors):
        sums = [[x for x in v[b::64]] for b in range(64)]
        code = sum(1 << b for b, xs in enumerate(sums) if None not in xs and sum(xs) > 0)
        assert got[i] == (code - (1 << 64) if code >> 63 else code)
    assert got[99] == 0


def test_masks_of_any_radius(monkeypatch):
    monkeypatch.setattr(multiindex, "MASKS_AT_ONCE", 100)
    for radius in range(12):
        parts = list(multiindex._masks(11, radius))
        assert all(len(p) <= 100 for p in parts)
        assert sorted(int(x) for p in parts for x in p) == [x for x in range(1 << 11) if x.bit_count() == radius]


@pytest.mark.parametrize("at_once", [1, 7])
def test_top_k_a_few_probes_at_once(spark, monkeypatch, at_once):
    monkeypatch.setattr(multiindex, "PROBES_AT_ONCE", at_once)
    pending = spark.createDataFrame([(-5, 3, 4), (7, 64, 2)], "q long, most int, need int")
    got = sorted(tuple(r) for r in multiindex._probes(pending, multiindex.segments(10), 1).collect())
    want = [(q, most, seg, (((q >> 16 * seg) & 0xFFFF) ^ (1 << b))) for q, most, need in [(-5, 3, 4), (7, 64, 2)] for seg in range(need) for b in range(16)]
    assert got == sorted(want)


def test_top_k_of_codes_is_exact(spark):
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 2**62))
    rows = [(i, int(rng.integers(-(2**63), 2**63 - 1))) for i in range(150)]
    for i in range(150, 300):  # a crowd around one code, with repeats
        code = centre
        for _ in range(i % 3):
            code ^= 1 << int(rng.integers(0, 62))
        rows.append((i, code))
    rows += [(400, None), (None, 5), rows[160], (500, 0), (600, -1)]
    codes = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, code long, rank int")
    got = {tuple(r) for r in multiindex.top_k(codes, F.expr("vec_id % 50 = 0"), k=7).collect()}
    fine = {(i, c) for i, c in rows if i is not None and c is not None}
    want = set()
    for i, c in fine:
        if i % 50 == 0:
            others = sorted(((c ^ d) & (2**64 - 1)).bit_count() * 1000 + j for j, d in fine if j != i)
            want |= {(i, rank, x % 1000, x // 1000) for rank, x in enumerate(others[:7], 1)}
    assert got == want
    empty = codes.limit(0)
    assert multiindex.top_k(empty, F.expr("vec_id % 50 = 0")).count() == 0
    assert multiindex.top_k(codes.filter("vec_id = 500"), F.expr("vec_id % 50 = 0")).count() == 0


def test_probes_are_not_broadcast(spark, monkeypatch):
    plans = []

    def run(df, label="cut"):
        if label == "best":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines())
        return cut(df, label)

    monkeypatch.setattr(multiindex, "cut", run)
    pick = np.random.default_rng(8)
    codes = spark.createDataFrame([(i, int(pick.integers(0, 2**36))) for i in range(300)], "vec_id long, code long")
    assert multiindex.top_k(codes, F.expr("vec_id % 50 = 0"), k=7).count() == 42
    assert len(plans) > 1
    for plan in plans:
        depth = [re.match(r"[ :]*(?:[+:]- )?", line).end() for line in plan]
        tasks = [k for k, line in enumerate(plan) if "InArrow" in line]
        assert tasks
        for k in tasks:
            left = depth[k]
            for above in reversed(range(k)):
                if depth[above] < left:
                    assert "BroadcastExchange" not in plan[above]
                    left = depth[above]


def _least_apart(fine, k, every):
    want = set()
    for i, c in fine:
        if i % every == 0:
            others = sorted({(((c ^ d) & (2**64 - 1)).bit_count(), j) for j, d in fine})
            want |= {(i, rank, j, apart) for rank, (apart, j) in enumerate([x for x in others[:k + 1] if x[1] != i][:k], 1)}
    return want


def test_top_k_over_cells_in_parts_and_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "CELL_CODES", 16)
    monkeypatch.setattr(multiindex, "QUERY_BLOCK", 5)
    monkeypatch.setattr(multiindex, "SENT_AT_ONCE", 50)
    pick = np.random.default_rng(9)
    low = [int(x) for x in pick.integers(0, 2**30, 260)]
    fine = {(i, (c << 34) - 2**63 if i % 3 else c) for i, c in enumerate(low)}  # half of the cells are crowded
    fine |= {(i + 300, c) for i, c in sorted(fine)[:120:2]} | {(i + 600, c) for i, c in sorted(fine)[:120:4]}
    fine |= {(7, low[3] ^ 1), (7, low[3] ^ 2)}  # one id, equally far
    codes = spark.createDataFrame(sorted(fine), "vec_id long, code long")
    got = {tuple(r) for r in multiindex.top_k(codes, F.expr("vec_id % 20 = 0"), k=6).collect()}
    assert got == _least_apart(fine, 6, 20)


def test_queries_travel_once_to_a_cell(spark, monkeypatch):
    sent, probes = [], multiindex._probes

    def count(*args):
        sent.append(probes(*args).count())
        return probes(*args)

    monkeypatch.setattr(multiindex, "_probes", count)
    pick = np.random.default_rng(8)
    codes = spark.createDataFrame([(i, int(pick.integers(0, 2**48))) for i in range(300)], "vec_id long, code long")
    assert multiindex.top_k(codes, F.expr("vec_id % 50 = 0"), k=7).count() == 42
    assert len(sent) > 1 and max(sent) <= 6 * 4


@pytest.mark.parametrize("at_once", [1, 40, 10_000])
def test_search_of_a_cell(monkeypatch, at_once):
    for name in ("MASKS_AT_ONCE", "PROBES_AT_ONCE", "MET_AT_ONCE"):
        monkeypatch.setattr(multiindex, name, at_once)
    pick = np.random.default_rng(3)
    codes = np.unique(pick.integers(0, 2**7, 90, dtype=np.uint64) | pick.integers(0, 2, 90, dtype=np.uint64) << np.uint64(40))
    codes = codes[np.argsort(codes & np.uint64(31), kind="stable")]
    members = [sorted({int(x) for x in pick.integers(0, 60, 1 + i % 4)}) for i in range(len(codes))]  # ids of several codes
    ends = np.concatenate([[0], np.cumsum([len(x) for x in members])])
    cell = multiindex._Cell(multiindex.pickle.dumps((codes, np.concatenate(members), ends)), (0, 5), 0, 4)
    q, most = codes[::7], np.full(len(codes[::7]), 9, dtype=np.int32)
    most[0] = 1
    for radius in range(7):
        got = set(zip(*(x.tolist() for x in cell.nearest(q, most, radius)), strict=True))
        want = set()
        for i, a in enumerate(q.tolist()):
            met = {((a ^ b).bit_count(), x) for b, xs in zip(codes.tolist(), members, strict=True) for x in xs if ((a ^ b) & 31).bit_count() == radius}
            want |= {(i, *x) for x in sorted(x for x in met if x[0] <= most[i])[:5]}
        assert got == want


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_roles_of_rows_alike_in_id_and_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 2)
    rows = [(1, "u2", "same"), (1, "u1", "same"), *[(1, "u1", "same")] * 6, (None, "u0", "same"), (2, None, "same"), (3, "u", None), (4, None, "")]
    got = warc.with_roles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    roles = sorted(((r["page_id"], r["url"], r["html"], r["refers_to"], r["revisit"]) for r in got), key=repr)
    want = [(1, "u1", "same", None, False), *[(1, "u1", "", 1, True)] * 6, (1, "u2", "", 1, True), (None, "u0", "", 1, True),
            (2, None, "", 1, True), (3, "u", "", None, False), (4, None, "", 3, True)]
    assert roles == sorted(want, key=repr)
