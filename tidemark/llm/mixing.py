"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are cut into blocks in a shuffled, repeatable order. With weight w, block k of a source is released
at slot floor(k / w) and due by slot ceil((k + 1) / w); every slot takes the released block that is due first. All blocks
then meet their deadlines, so after any number of slots each source is less than one block off its weight. Weights are
whole shares of a period, so the schedule of one period stands for all: a block's slot follows from its number alone.
When a source runs out, the weights of the others are scaled up and a new phase begins, so no document is dropped.

Past a number of sources the smaller ones are mixed on two levels: groups of sources that last about as long are scheduled
as one source, and inside each group its sources' blocks are scheduled in a task of their own. Any number is placed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Slots of a period: weights are rounded to this part. The schedules of all phases have MOST_SOURCES * PERIOD rows at most.
PERIOD, MOST_SOURCES = 2000, 200
#: With more sources, one stays by itself that holds more than one in HEAD of the documents; the others are grouped by how
#: long they last, in LEVELS powers of two, and by hash. A task places the blocks of one group.
HEAD, LEVELS, HASHED = 100, 6, 16
#: Documents of a block, and of the runs that are numbered one by one in a task.
BLOCK, RUN = 64, 2000
#: Exponent that damps the sizes of sources where no weights are given.
TEMPERATURE = 0.5


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares of the period in proportion to the weights, one at least, by largest remainder."""
    total = sum(weights.values())
    exact = {s: period * w / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    at = 0
    while sum(out.values()) < period:
        out[by_rest[at % len(by_rest)]] += 1
        at += 1
    while sum(out.values()) > period:
        largest = max(out, key=lambda s: (out[s], s))
        out[largest] -= 1
    return out


def schedule(share: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """Earliest deadline first over one period: (source, block, slot, release, deadline) in slot order."""
    period = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // share[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, slot, release, deadline))
        if k + 1 < share[s]:
            heapq.heappush(waiting, ((k + 1) * period // share[s], s, k + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> list[dict]:
    """Phases until all blocks are placed: shares, first slot, and how many blocks of each source came before."""
    left = {s: b for s, b in blocks.items() if b > 0 and weights.get(s, 0) > 0}
    done, slot, out = dict.fromkeys(left, 0), 0, []
    while left:
        size = max(period, len(left))
        share = shares({s: weights[s] for s in left}, size)
        table = schedule(share)
        slot_of = {(s, k): at for s, k, at, _, _ in table}
        # The phase ends with the last block of the source that runs out first.
        ends = {s: (b - 1) // share[s] * size + slot_of[s, (b - 1) % share[s]] + 1 for s, b in left.items()}
        length = min(ends.values())
        out.append({"share": share, "slot": slot, "done": dict(done)})
        full, rest = divmod(length, size)
        served = {s: full * share[s] for s in left}
        for s, _, at, _, _ in table:
            if at < rest:
                served[s] += 1
        for s, n in served.items():
            done[s] += n
            left[s] -= n
        left = {s: b for s, b in left.items() if b > 0}
        slot += length
    return out


def interleaved(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """(source, block) of all blocks, earliest deadline first among those released, for any number of sources.

    Time runs faster as sources run out, as if their weights were given to the others.
    """
    ready = [(1 / w, i, 0) for i, w in enumerate(weights)]
    heapq.heapify(ready)
    waiting: list[tuple[float, int, int]] = []
    ends = [(b / w, w) for b, w in zip(blocks, weights, strict=True)]
    heapq.heapify(ends)
    now, active = 0.0, sum(weights)
    while ready or waiting:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, ((k + 1) / weights[i], i, k))
        _, i, k = heapq.heappop(ready)
        yield i, k
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, ((k + 1) / weights[i], i, k + 1))
        rest = 1.0
        while ends and (ends[0][0] - now) * active <= rest:
            end, w = heapq.heappop(ends)
            rest -= max(0.0, end - now) * active
            now, active = max(now, end), active - w
        if ends:
            now += rest / active


def _interleaved(group: pa.Table) -> pa.Table:
    group = group.sort_by("__source")
    names, numbers = group.column("__source").combine_chunks(), [c.to_pylist() for c in (group.column("__blocks"), group.column("__weight"))]
    order = list(interleaved(*numbers))
    return pa.table({
        "__source": names.take(pa.array([i for i, _ in order], pa.int64())), "block": pa.array([k for _, k in order], pa.int64()),
        "__unit": group.column("__unit").combine_chunks().take(pa.array([0] * len(order), pa.int64())),
        "__nth_of_unit": pa.array(range(len(order)), pa.int64()), "__own_slot": pa.nulls(len(order), pa.int64())})


def _schedules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for phase, names, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = schedule(dict(zip(names, values, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([phase] * len(rows), pa.int32()), *(pa.array(list(c)) for c in zip(*rows, strict=True))],
                names=["phase", "__unit", "__nth", "__slot", "__release", "__deadline"])


def _named(source: F.Column) -> F.Column:
    """A null source is a source of its own."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with __source and __number (from 0, in shuffled order within its source), and (__source, n) documents.

    A source of any size is numbered in runs of hashes, so none is sorted in one task.
    """
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__source", _named(F.col("source"))).withColumn("__h", F.xxhash64("doc_id", text))
    counted = cut(keyed.groupBy("__source", F.shiftrightunsigned("__h", 44).alias("__fine")).count(), "hash-counts")
    totals = counted.groupBy("__source").agg(F.sum("count").alias("n"))
    most = totals.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    bits = min(20, max(0, (most // RUN).bit_length()))
    keyed = keyed.withColumn("__run", F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("long"))
    runs = counted.groupBy("__source", F.shiftrightunsigned("__fine", 20 - bits).alias("__run")).agg(F.sum("count").alias("n"))
    before = Window.partitionBy("__source").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("__source", "__run").orderBy("__h", F.col("doc_id").asc_nulls_last(), text.asc_nulls_last()))
    return keyed.join(runs, ["__source", "__run"]).withColumn("__number", F.col("__first") + nth - 1), totals


def _before(rows: DataFrame, name: str, count: str) -> DataFrame:
    """``rows`` with __before: the sum of ``count`` over rows of smaller ``name``; no task sorts them all."""
    dealt = cut(rows.repartitionByRange(name).withColumn("__part", F.spark_partition_id()), "dealt")
    sums = F.broadcast(dealt.groupBy("__part").agg(F.sum(count).alias("n")).withColumn(
        "__offset", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n"))
    inside = Window.partitionBy("__part").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(sums, "__part").withColumn("__before", F.col("__offset") + F.coalesce(F.sum(count).over(inside), F.lit(0))).drop(
        "__part", "__offset")


def _grouped(totals: DataFrame, head: list[str], weights: dict[str, float] | None, block: int) -> tuple:
    """Sources beyond ``head`` as groups: blocks and weight of each group, (__source, block, __unit, __nth_of_unit,
    __own_slot) of their blocks, and blocks before each source of the head that has no weight.

    A block without a weight has no group but its slot after the mix, __own_slot.
    """
    if weights is None:
        rows = totals.withColumn("__weight", F.pow("n", F.lit(TEMPERATURE)))
    else:
        given = totals.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "__source string, __weight double")
        rows = totals.join(given, "__source", "left").fillna({"__weight": 0.0})
    rows = cut(rows.withColumn("__blocks", F.ceil(F.col("n") / block).cast("long")), "sources")
    weighted, tail = F.col("__weight") > 0, ~F.col("__source").isin(head)
    lasts = F.floor(F.log2(F.col("__blocks") / F.col("__weight")))
    small = rows.filter(weighted & tail)
    longest = small.agg(F.max(lasts)).first()[0] or 0
    level = F.least(F.lit(longest) - lasts, F.lit(LEVELS - 1)).cast("long")
    small = small.withColumn("__unit", F.concat(
        F.lit("#"), (level * HASHED + F.pmod(F.xxhash64("__source"), F.lit(HASHED))).cast("string")))
    groups = {r["__unit"]: (r["b"], r["w"]) for r in small.groupBy("__unit").agg(
        F.sum("__blocks").alias("b"), F.sum("__weight").alias("w")).collect()}
    kind = "__source string, block long, __unit string, __nth_of_unit long, __own_slot long"
    placed = small.select("__source", "__blocks", "__weight", "__unit").groupBy("__unit").applyInArrow(_interleaved, kind)
    after = _before(rows.filter(~weighted), "__source", "__blocks")
    total = rows.filter(weighted).agg(F.coalesce(F.sum("__blocks"), F.lit(0))).first()[0]
    rest = after.filter(tail).select(
        "__source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("__unit"),
        F.lit(None).cast("long").alias("__nth_of_unit"), (F.lit(total) + F.col("__before") + F.col("block")).alias("__own_slot"))
    ends = {r["__source"]: total + r["__before"] for r in after.filter(~tail).collect()}
    return groups, cut(placed.unionByName(rest), "placed"), ends


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with its place in the mix: phase, block (of its source), slot, release, deadline, position.

    ``weights`` are the target weights by source; without any, the square roots of the sources' numbers of documents.
    position orders the rows (slot * block + place in the block; gaps where a last block is short). release and deadline
    are slots of the whole mix; of a source in a group (with more than ``MOST_SOURCES``), those of its group's block at that
    place. No document is dropped or repeated: sources without a positive weight come after the mix,
    by name, with phase, release and deadline null.

    A null source is a source (None in ``weights``). Null ids and texts and repeated rows are placed as any row. Long
    texts count as one document. An empty table gives no rows. Columns of ``docs`` named as the new ones give way.
    """
    spark = docs.sparkSession
    own = docs.drop("phase", "block", "slot", "release", "deadline", "position")
    # Other columns go under names of their own, so that none meets one that is used here.
    inner = [c if c in ("doc_id", "text", "source") else f"own_{i}" for i, c in enumerate(own.columns)]
    rows, totals = numbered(own.toDF(*inner))
    named = None if weights is None else {"" if s is None else f"={s}": w for s, w in weights.items()}
    largest = totals.orderBy(F.desc("n"), "__source").limit(MOST_SOURCES + 1).collect()
    many = len(largest) > MOST_SOURCES
    whole = totals.agg(F.sum("n")).first()[0] if many else 0
    sizes = {r["__source"]: r["n"] for r in largest if not many or r["n"] * HEAD > whole}
    units = {s: n ** TEMPERATURE for s, n in sizes.items()} if named is None else {s: named.get(s, 0) for s in sizes}
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    groups, placed, ends = _grouped(totals, list(sizes), named, block) if many else ({}, None, {})
    units |= {g: w for g, (_, w) in groups.items()}
    blocks |= {g: b for g, (b, _) in groups.items()}
    plan = phases(blocks, units)
    total = sum(b for s, b in blocks.items() if units.get(s, 0) > 0)
    spec = spark.createDataFrame(
        [(i, list(p["share"]), list(p["share"].values())) for i, p in enumerate(plan)], "phase int, names array<string>, shares array<int>")
    # At most MOST_SOURCES phases of PERIOD rows each: small enough to be sent to every executor, whatever the documents.
    slots = F.broadcast(spec.repartition(max(1, len(plan))).mapInArrow(
        _schedules, "phase int, __unit string, __nth long, __slot long, __release long, __deadline long"))
    starts, after = [], total
    for s in sorted(blocks):
        mine = [(i, p["done"][s], p["share"][s], p["slot"], sum(p["share"].values())) for i, p in enumerate(plan) if s in p["share"]]
        starts.append((s, mine, None if mine else ends.get(s, after)))
        after += 0 if mine else blocks[s]
    of_source = F.broadcast(spark.createDataFrame(
        starts, "__unit string, __phases array<struct<phase:int,done:long,share:long,slot:long,period:long>>, __after long"))
    rows = rows.withColumn("block", F.floor(F.col("__number") / block).cast("long"))
    if many:
        # Blocks of the head have no row there: each is its source's own.
        rows = rows.join(placed, ["__source", "block"], "left")
        rows = rows.withColumn("__unit", F.when(F.col("__own_slot").isNull(), F.coalesce("__unit", "__source")))
        rows = rows.withColumn("__ublock", F.coalesce("__nth_of_unit", "block"))
    else:
        rows = rows.withColumns({"__unit": F.col("__source"), "__ublock": F.col("block"), "__own_slot": F.lit(None).cast("long")})
    rows = rows.join(of_source, "__unit", "left")
    rows = rows.withColumn("__at", F.try_element_at(F.filter("__phases", lambda p: p["done"] <= F.col("__ublock")), F.lit(-1)))
    rows = rows.withColumn("phase", F.col("__at.phase")).withColumn("__k", F.col("__ublock") - F.col("__at.done"))
    rows = rows.withColumn("__nth", F.pmod("__k", F.col("__at.share"))).withColumn(
        "__base", F.col("__at.slot") + F.floor(F.col("__k") / F.col("__at.share")).cast("long") * F.col("__at.period"))
    rows = rows.join(slots, ["phase", "__unit", "__nth"], "left")
    slot = F.coalesce(F.col("__base") + F.col("__slot"), "__own_slot", F.col("__after") + F.col("block"))
    return rows.withColumn("slot", slot).select(
        *[F.col(n).alias(c) for n, c in zip(inner, own.columns, strict=True)], "phase", "block", "slot", (F.col("__base") + F.col("__release")).alias("release"),
        (F.col("__base") + F.col("__deadline")).alias("deadline"),
        (F.col("slot") * block + F.pmod("__number", F.lit(block))).alias("position"))


def in_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` in the order of the mix: files written from it hold consecutive stretches; columns are kept.

    Every row stays, with null or repeated ids, texts and sources as ``mixed`` has them; columns may have any name.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumns({c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text", "source")})
    # The texts go on under their new names only.
    placed = mixed(rows.withColumn("text", F.sha1(F.col("text").cast("string"))), weights, block)
    ordered = placed.repartitionByRange("position").sortWithinPartitions("position")
    return ordered.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


#: Where a row stands in the files it was read from: number of the file, its path, row of the file.
PLACE = ("at_part", "at_file", "at_row")


def located(docs: DataFrame) -> DataFrame:
    """``docs``, read from files, with the columns ``PLACE``; columns of these names give way."""
    file = docs.metadataColumn("_metadata")
    part = F.regexp_extract(file["file_name"], r"part-(\d+)", 1).try_cast("long")
    return docs.withColumns(dict(zip(PLACE, (part, file["file_path"], file["row_index"]), strict=True)))


def placed(rows: DataFrame, size: str) -> DataFrame:
    """``rows`` of ``located`` documents with their place in the mix instead of that in the files: position (from 0) and
    offset, the sum of ``size`` over the rows before.

    Files follow each other by number, as one write leaves them. A file, what one task wrote, is ordered by itself; of
    each file one row is ordered with those of the others. Files of no rows do not count; no rows give no rows.
    """
    rows = cut(rows, "encoded")
    files = rows.groupBy(*PLACE[:2]).agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__size"))
    earlier = Window.orderBy("at_part", F.length("at_file"), "at_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("at_file", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("__n", "__size")))
    inside = Window.partitionBy("at_file").orderBy("at_row")
    before = F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumns({"__nth": F.row_number().over(inside) - 1, "__inside": before})
    return numbered.join(F.broadcast(files), "at_file").withColumns({
        "position": F.col("__n_before") + F.col("__nth"), "offset": F.col("__size_before") + F.col("__inside")}).drop(
        *PLACE, "__nth", "__inside", "__n_before", "__size_before")
