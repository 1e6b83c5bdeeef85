"""The registered queries of this package and, where SQL can say it, the text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, gru, hnsw, jaccard, langid, mixing, multiindex, pathratio, phrases, secrets, suffixes, turns, warc

#: Vocabulary file of op9; every executor has the package it lies in.
VOCABULARY = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"), n=3, percent=90).drop("row_key")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return placed.drop("text")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL AND size(embedding) > 0")
    codes = rows.select("vec_id", multiindex.sign_code(F.col("embedding")).alias("code"))
    return multiindex.top_k(codes, F.expr("vec_id % 100 = 0"), k=10)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = gru.score(docs, langid.fold(docs, 7) != 2)
    return rows.select("doc_id", (~F.col("trained")).alias("held_out"), *rows.columns[2:])


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathratio.extract(_table(spark, sf_dir, "pages"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_source_mix": op2_source_mix,
    "op3_top_k": op3_top_k,
    "op4_warc": op4_warc,
    "op5_language_id": op5_language_id,
    "op6_lm_score": op6_lm_score,
    "op7_html_extraction": op7_html_extraction,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_bpe": op9_bpe,
    "op10_secret_scan": op10_secret_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLES: dict[str, str] = {
    "op1_jaccard_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words),
sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
overlap AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM overlap JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
    WHERE 100 * o >= 90 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, coalesce(g.n_links, 0) AS n_links
FROM documents d LEFT JOIN sized s USING (doc_id) JOIN least l ON l.a = d.doc_id LEFT JOIN degree g ON g.a = d.doc_id""",
    "op3_top_k": r"""
WITH bits AS (
    SELECT vec_id, [CASE WHEN list_sum([embedding[j]::DOUBLE FOR j IN range(i + 1, len(embedding) + 1, 64)]) > 0 THEN 1 ELSE 0 END
                    FOR i IN range(0, 64)] AS b
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
codes AS (SELECT vec_id, list_aggregate(b, 'string_agg', '')::BIT AS code FROM bits),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INTEGER AS distance
    FROM codes q JOIN codes c ON q.vec_id % 100 = 0 AND c.vec_id != q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10""",
    "op10_secret_scan": r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents),
cut AS (
    SELECT row_id, 0 AS kind, regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
           string_split_regex(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS lead FROM docs
    UNION ALL SELECT row_id, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM docs
    UNION ALL SELECT row_id, 2, regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM docs
    UNION ALL SELECT row_id, 3, regexp_extract_all(text, '[A-Za-z0-9+/_=-]+'), string_split_regex(text, '[A-Za-z0-9+/_=-]+') FROM docs),
matches AS (SELECT row_id, kind, unnest(range(1, len(lead) + 1)) AS k, unnest(lead) AS lead, unnest(m) AS match FROM cut WHERE len(m) > 0),
placed AS (
    SELECT row_id, kind, match, sum(length(lead) + coalesce(length(match), 0)) OVER (PARTITION BY row_id, kind ORDER BY k) AS end_at,
           CASE WHEN kind = 0 THEN regexp_extract(match, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
                ELSE match END AS value
    FROM matches),
spans AS (
    SELECT row_id, kind, end_at - length(match) AS start_at, end_at, value, doc_id, source
    FROM placed JOIN docs USING (row_id)
    WHERE match IS NOT NULL AND length(value) >= [6, 20, 24, 20][kind + 1] AND (kind < 3 OR regexp_matches(value, '[0-9]'))),
held AS (
    SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners,
           count(DISTINCT coalesce('=' || source, '') || chr(1) || coalesce(doc_id::VARCHAR, '')) AS repositories
    FROM spans GROUP BY value),
told AS (
    SELECT *, owners >= 3 OR repositories >= owners * 10 AS copied,
           length(value) >= 12 AND len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]')
           AND regexp_matches(value, '[A-Za-z]') AS random
    FROM spans JOIN held USING (value)),
base AS (SELECT *, ['assign', 'access', 'hex'][kind + 1] || ':' || start_at || ':' || end_at AS span FROM told WHERE kind < 3),
own AS (
    SELECT *, 'owned:' || start_at || ':' || end_at AS span FROM told o
    WHERE kind = 3 AND owners = 1 AND NOT copied AND random
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row_id = o.row_id AND b.start_at < o.end_at AND o.start_at < b.end_at)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM own)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
       count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start_at, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start_at, kind), '') AS spans, count(*) FILTER (kind = 3) AS n_owned,
       count(*) FILTER (kind < 3 AND random AND NOT copied) AS n_live, count(*) FILTER (kind < 3 AND copied) AS n_copied,
       coalesce(string_agg(owners::VARCHAR, ',' ORDER BY start_at, kind), '') AS owners,
       coalesce(string_agg(repositories::VARCHAR, ',' ORDER BY start_at, kind), '') AS repositories
FROM docs d LEFT JOIN found f USING (row_id) GROUP BY row_id""",
    # crc32 bit by bit: a byte is mixed in, then eight steps (-1) follow.
    "op11_prefix_trie": r"""
WITH t AS (
    SELECT conv_id, turn, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
    SELECT conv_id, t, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(t.r), ':', t.r, t.x))) AS place FROM t),
members AS (
    SELECT conv_id, conv_id - conv_id % 20 AS first, xor(list_reduce(
        [4294967295] || flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(conv_id::VARCHAR, '')]),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS share
    FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
    SELECT m.conv_id, place, t FROM members m JOIN placed p ON p.conv_id = m.first AND place <= share
    UNION ALL SELECT m.conv_id, place, t FROM members m JOIN placed p ON p.conv_id = m.conv_id AND place > share),
whole AS (
    SELECT m.conv_id, coalesce(list(t ORDER BY place) FILTER (place IS NOT NULL), []) AS s
    FROM members m LEFT JOIN rebuilt USING (conv_id) GROUP BY m.conv_id),
nodes AS (
    SELECT p, min(conv_id) AS conv_id, count(*) AS n_convs
    FROM (SELECT conv_id, unnest([s[1:d] FOR d IN range(0, len(s) + 1)]) AS p FROM whole) GROUP BY p),
children AS (SELECT p[1:len(p) - 1] AS p, count(*) AS n_children FROM nodes WHERE len(p) > 0 GROUP BY 1),
ends AS (SELECT s AS p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM whole GROUP BY s),
sums AS (
    SELECT a AS p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (
        SELECT unnest([p[1:d] FOR d IN range(0, len(p) + 1)]) AS a, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
               CASE WHEN len(p) = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[len(p)].x, '[^ 	-
]+')) END AS saved
        FROM nodes LEFT JOIN children USING (p)) GROUP BY a)
SELECT n.conv_id, len(n.p)::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums USING (p) LEFT JOIN children USING (p) LEFT JOIN ends USING (p)
LEFT JOIN nodes u ON len(n.p) > 0 AND u.p = n.p[1:len(n.p) - 1]""",
    "op12_phrase_mining": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
counts AS (
    SELECT lang, m, p, count(*) AS f FROM (
        SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS p
        FROM words, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE len(w) >= m) GROUP BY lang, m, p),
candidates AS (SELECT lang, m, p, f AS a, string_split(p, ' ') AS w FROM counts WHERE m > 1 AND f >= 30),
cuts AS (
    SELECT lang, p, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (
    SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score,
           row_number() OVER (PARTITION BY c.lang, c.p ORDER BY 2000000::HUGEINT * c.a // (x.f + y.f), c.k) AS nth
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.head JOIN counts y ON y.lang = c.lang AND y.p = c.tail),
inside AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS p, max(a) AS longer
    FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates)) GROUP BY 1, 2),
kept AS (
    SELECT s.* FROM scored s LEFT JOIN inside i USING (lang, p) WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 80 * a)),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang)
SELECT lang, rank, p AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept) JOIN total USING (lang)
WHERE rank <= 2000""",
    "op13_suffix_dedup": r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM texts)),
later AS (
    SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step
    FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM strings) WHERE nth > 1),
spans AS (
    SELECT doc_id, min(i) AS low, max(i) + 100 AS high
    FROM (SELECT doc_id, i, count(*) FILTER (step IS NULL OR step > 100) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM later)
    GROUP BY doc_id, span),
kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS head, max(high) AS high,
           sum(high - low) AS n_removed, count(*) AS n_spans
    FROM (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM spans) JOIN texts USING (doc_id)
    GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(high, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)""",
}
