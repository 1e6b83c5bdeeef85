"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Spans of each kind come from one pattern per kind. The hash of every candidate is aggregated over the corpus by distinct
repositories and owners: a value that several owners hold, or that owners hold in many repositories each, is a widely
copied example; one that a single owner holds in few and that looks random is live-looking. Base kinds keep all their spans and get the class besides; the kind ``owned``, random
runs that no keyword announces, is a finding only where the corpus shows it to be one owner's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.streams import free
from tidemark.session import cut

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter run never counts, and a run is matched whole or not at all, so the bound may stand in the pattern. Of the runs
#: that no keyword announces only those with a digit are candidates.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
OWNED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST_ASSIGNED = 6
#: A value held by so many owners is a copied example, and so is one in so many repositories for each of its owners.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
#: A live-looking value: so long, of so many different characters, with letters and digits.
LIVE_CHARS, LIVE_DISTINCT = 12, 8


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """Per match the text before it since the last one, and the match."""
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("lead"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    rows = F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.cast("int").alias("at"), F.length(m["lead"]).cast("long").alias("lead"), m["match"].alias("match")))
    # The last piece has no match after it.
    return F.when(text.rlike(pattern), F.filter(rows, lambda m: m["match"].isNotNull()))


def spans(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per candidate span of every row of ``docs``, and one row without a span where a text has none.

    Columns: row_id, doc_id, row_key, kind, start_at, end_at (code points, end exclusive), value, digest, owner, repository.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), row_key().alias("row_key"),
        F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text.alias("text"))
    found = F.flatten(F.array_compact(F.array(
        *(_matches(F.col("text"), k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, OWNED))))))
    empty = F.size(found) == 0
    nothing = F.array(F.struct(
        F.lit(None).cast("int").alias("kind"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("lead"),
        F.lit(None).cast("string").alias("match")))
    rows = rows.select("row_id", "doc_id", "row_key", "owner", "repository", F.when(empty, nothing).otherwise(found).alias("found"))
    rows = rows.select("row_id", "doc_id", "row_key", "owner", "repository", F.inline("found"))
    # Where a match starts: all that lies before it, match by match.
    before = Window.partitionBy("row_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("lead") + F.length("match")).over(before)
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    rows = rows.withColumn("end_at", end).withColumn("value", value)
    keep = ((F.col("kind") != 0) | (F.length("value") >= LEAST_ASSIGNED)) & ((F.col("kind") != 3) | F.col("value").rlike("[0-9]"))
    return rows.select(
        "row_id", "doc_id", "row_key", "owner", "repository", F.when(keep, F.col("kind")).alias("kind"),
        (F.col("end_at") - F.length("match")).alias("start_at"), "end_at", "value", F.when(keep, F.xxhash64("value")).alias("digest"))


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories): distinct owners and (owner, repository) pairs that hold each candidate.

    Summed level by level, so a value in a third of all documents is merged before each shuffle. A null owner counts as
    one owner, a null repository as one repository of its owner.
    """
    held = found.filter("digest IS NOT NULL")
    per_repository = held.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = per_repository.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def _live_looking(value: Column) -> Column:
    different = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_CHARS) & (different >= LIVE_DISTINCT) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def classified(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``spans`` with owners, repositories, ``copied`` (held by several owners, or in many repositories of each) and ``live``
    (few owners' in few repositories, and random-looking)."""
    found = cut(spans(docs, owner, repository), "spans")
    many = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= F.col("owners") * EXAMPLE_REPOSITORIES)
    owned = ownership(found).select("digest", "owners", "repositories", many.alias("copied"), (F.col("owners") == 1).alias("single"))
    rows = found.filter("digest IS NOT NULL").join(owned, "digest")
    rows = rows.withColumn("live", ~F.col("copied") & _live_looking(F.col("value")))
    # A random run is a finding only where one owner holds it, and not as a copied example.
    rows = rows.withColumn("kind", F.when((F.col("kind") == 3) & ~(F.col("live") & F.col("single")), F.lit(None)).otherwise(F.col("kind")))
    none, no = F.lit(None).cast("long"), F.lit(False)
    nothing = found.filter("digest IS NULL").withColumns({"owners": none, "repositories": none, "copied": no, "single": no, "live": no})
    return rows.unionByName(nothing)


def _joined(items: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start_at"].cast("string"), s["end_at"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Secrets of every row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied,
    owners, repositories.

    ``spans`` joins kind:start:end by start, then kind (code points, end exclusive); owners and repositories join, in the
    same order, the numbers that hold each span's value; base_sha256 is the digest of the text of ``spans`` for the three
    base kinds. n_live and n_copied count base spans whose value is live-looking or a copied
    example. A random run that overlaps a base span is not reported again.

    Null and empty texts have no spans. Whole texts are scanned, however long. Repeated rows are rows of their own here,
    and one holder in ownership. Null owners and repositories count as one. An empty table gives no rows. Columns other
    than doc_id, text, owner and repository are ignored, whatever their names.
    """
    rows = classified(docs, owner, repository)
    item = F.struct("start_at", "kind", "end_at", "live", "copied", "owners", "repositories")
    grouped = rows.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), item))).alias("found"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    grouped = grouped.withColumn("base", base).withColumn("owned", F.filter("found", lambda s: (s["kind"] == 3) & ~F.exists(
        "base", lambda b: (b["start_at"] < s["end_at"]) & (s["start_at"] < b["end_at"]))))

    def count(items: str, test) -> Column:
        return F.size(F.filter(items, test)).cast("long")

    def of_kind(k: int):
        return lambda s: s["kind"] == k

    def numbers(name: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.concat("base", "owned")), lambda s: s[name].cast("string")), ",").alias(name)

    return grouped.select(
        "doc_id", *(count("base", of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "owned"))).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"), count("base", lambda s: s["live"]).alias("n_live"),
        count("base", lambda s: s["copied"]).alias("n_copied"), numbers("owners"), numbers("repositories"))


def row_key() -> Column:
    """A number alike for rows of one doc_id and text."""
    doc, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    return F.xxhash64(doc, doc.isNull(), text, text.isNull())


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret's characters replaced by ``mark``; copied examples that several owners hold stay.

    What a single owner holds goes in however many repositories it stands: only owners tell an example from a key in use.

    Every document stays, repeated rows and those with null or empty text too, and every column but ``text`` is as it was,
    whatever the names of the others. Overlapping spans are replaced as one. A null owner or repository counts as one. An
    empty table gives no rows.
    """
    rows = classified(docs, owner, repository).filter("kind IS NOT NULL AND (owners = 1 OR NOT copied)")
    key, held = free("__row_key", docs.columns), free("__spans", docs.columns)
    found = rows.groupBy(F.col("row_key").alias(key)).agg(F.array_sort(F.collect_set(F.struct("start_at", "end_at"))).alias(held))
    first = F.transform(held, lambda s, i: F.struct(
        s["start_at"].alias("start_at"), s["end_at"].alias("end_at"),
        F.coalesce(F.array_max(F.transform(F.slice(held, 1, i), lambda e: e["end_at"])), F.lit(0)).alias("done")))
    keyed = docs.withColumn(key, row_key()).join(found, key, "left")
    text = F.col("text").cast("string")
    pieces = F.transform(first, lambda s: F.when(s["start_at"] >= s["done"], F.concat(
        F.substring(text, s["done"].cast("int") + 1, (s["start_at"] - s["done"]).cast("int")), F.lit(mark))).otherwise(F.lit("")))
    tail = F.substring(text, F.array_max(F.transform(held, lambda s: s["end_at"])).cast("int") + 1, F.length(text))
    clean = F.when(F.col(held).isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return keyed.withColumn("text", clean).select(*docs.columns)
