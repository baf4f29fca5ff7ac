"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows whose texts are equal are an atomic group; groups are ordered by a 64-bit hash of the text.  The smallest
feasible capacity of a shard is found by binary search; each trial fills shards greedily in order, finding every cut
by a search in the prefix sums.  The shards are cut there.

The prefix sums of all groups are never in one place.  The search runs over ranges of hashes, at first 2**16 of
them, as if they were groups.  That brackets the capacity: the ranges' own is enough, and none is below the
largest group and the mean.  Where a cut of some capacity in between may fall inside a range, the range is split
into 2**8; when all ranges that matter are single groups, the capacity is the smallest for the groups themselves.
How many ranges matter follows the shards and the spread of sizes, not the number of groups.

Slots inside a shard are gapless: the offset of the row's cell (a 2**16th of the hashes), plus the offset of a part
of it (cells of many rows are dealt into about sqrt(rows) parts by id), plus the rank in it.

Defined cases: null text counts as no bytes and as equal to the empty text; rows that are alike in all
columns get different slots; an empty table gives an empty result; null and repeated ids are dealt like others;
further columns pass through, whatever their names, except those that are put last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, others, packed, unpacked

#: Bits of the first ranges and of the cells of slots, and by how many a range is split.
CELL_BITS, SPLIT_BITS = 16, 8
OVERHEAD = 16
#: Rows of a cell that are ranked together, at least.
RANKED = 256
#: Ranges that a search reaches, as a power of two.
_REACH = 24

#: Smallest capacity, the least that any can be, and the index of the last range in each shard.  ``p``: prefix sums with a leading 0.
_SEARCH = """
WITH s AS (SELECT *, size(p) - 1 AS n, get(p, size(p) - 1) AS total FROM {cells}),
b AS (SELECT *, greatest(most, (total + {k} - 1) div {k}) AS least FROM s),
c AS (SELECT *, aggregate(sequence(1, 63), struct(least AS lo, (total + {k} - 1) div {k} + most AS hi),
        (a, i) -> if(a.lo >= a.hi, a,
            if({fill} = n,
               struct(a.lo AS lo, (a.lo + a.hi) div 2 AS hi),
               struct((a.lo + a.hi) div 2 + 1 AS lo, a.hi AS hi)))).hi AS capacity FROM b)
SELECT *, {ends} AS ends FROM c
"""

#: Ranges in which a cut may fall: from ``low``, the cuts of the least capacity, to ``high``, how far the capacity reaches
#: at most (a single group is not cut).
_ACTIVE = """
WITH l AS (SELECT *, {low} AS low, aggregate(sequence(1, {k}), cast(array() AS array<bigint>), (xs, k) -> concat(xs, array({far}))) AS high FROM {found}),
r AS (SELECT p, groups, bits, range, transform(sequence(1, {k}), j -> struct(get(p, get(low, j - 1)) AS lo, get(high, j - 1) AS hi)) AS spans FROM l)
SELECT x.bits, x.range FROM (SELECT explode(transform(filter(sequence(1, size(p) - 1), i -> get(groups, i - 1) > 1 AND exists(spans, s -> get(p, i) > s.lo AND get(p, i - 1) < s.hi)),
    i -> struct(get(bits, i - 1) AS bits, get(range, i - 1) AS range))) AS x FROM r)
"""


def _reach(start: str, capacity: str, value: str = "get(p, {})") -> str:
    """SQL: the last index whose prefix sum is at most that of ``start`` and ``capacity`` more."""
    steps = f"transform(sequence(0, {_REACH}), b -> shiftleft(1, {_REACH} - b))"
    return f"aggregate({steps}, {start}, (x, w) -> if(x + w <= n AND get(p, x + w) <= {value.format(start)} + {capacity}, x + w, x))"


def _ends(capacity: str, shards: int) -> str:
    """SQL: the last index of each shard that is filled greedily."""
    last = "if(size(ends) = 0, 0, get(ends, size(ends) - 1))"
    return f"aggregate(sequence(1, {shards}), cast(array() AS array<int>), (ends, k) -> concat(ends, array({_reach(last, capacity)})))"


def _query(sql: str, **frames: DataFrame) -> DataFrame:
    """``sql`` over frames, each under a name of its own, so that calls at the same time do not meet."""
    spark = next(iter(frames.values())).sparkSession
    names = {k: f"tesselink_{uuid.uuid4().hex}" for k in frames}
    for k, df in frames.items():
        df.createOrReplaceTempView(names[k])
    try:
        return spark.sql(sql.format(**names))
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def _searched(cells: DataFrame, shards: int) -> DataFrame:
    fill = f"aggregate(sequence(1, {shards}), 0, (at, k) -> {_reach('at', '(a.lo + a.hi) div 2')})"
    return _query(_SEARCH.format(cells="{cells}", k=shards, fill=fill, ends=_ends("capacity", shards)), cells=cells)


def minimax_cuts(cells: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Of one row (``p``: prefix sums from 0, ``most``: the largest group): the capacity and each shard's last group."""
    row = _searched(cells, shards).select("capacity", "ends").first()
    return row["capacity"], list(row["ends"])


def _ranges(groups: DataFrame, bits: int) -> DataFrame:
    """(bits, range, bytes, groups, most, last) of the ranges of so many bits."""
    return groups.groupBy(F.lit(bits).alias("bits"), F.shiftright("h", 64 - bits).alias("range")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("bytes").alias("most"), F.max("h").alias("last"))


def group_cuts(groups: DataFrame, shards: int, bits: int = CELL_BITS) -> tuple[int, list[int]]:
    """Of (h, bytes), a row for each group, in the order of h: the smallest capacity, and the h of each shard's last group.

    A shard that stays empty repeats the end before it; without groups there are no ends.
    """
    atoms = durable(_ranges(groups, bits))
    each = lambda c: F.transform("x", lambda e: e[c]).alias(c)
    while True:
        ahead = Window.orderBy("last").rowsBetween(Window.unboundedPreceding, 0)  # the ranges, not the groups
        row = F.sort_array(F.collect_list(F.struct("last", "sum", "groups", "bits", "range")))
        packed_rows = atoms.withColumn("sum", F.sum("bytes").over(ahead)).agg(row.alias("x"), F.max("most").alias("most")).where("size(x) > 0")
        table = packed_rows.select("most", *map(each, ("sum", "last", "groups", "bits", "range"))).withColumn("p", F.concat(F.array(F.lit(0).cast("long")), "sum")).drop("sum")
        found = durable(_searched(table, shards))
        state = found.select("capacity", "least", F.transform("ends", lambda e: F.get("last", e - 1)).alias("cuts")).first()
        if state is None:
            return 0, []
        far = f"""element_at(transform(array(if(size(xs) = 0, 0L, element_at(xs, -1)) + capacity), v -> element_at(transform(array({_reach('0', 'v', '0L')}),
                i -> if(i = n OR get(p, i) = v OR get(groups, i) = 1, get(p, i), v)), 1)), 1)"""
        open_ = durable(_query(_ACTIVE.format(found="{found}", k=shards, low=_ends("least", shards), far=far), found=found))
        if state["capacity"] == state["least"] or open_.isEmpty():
            return state["capacity"], list(state["cuts"])
        kept = atoms.join(F.broadcast(open_), ["bits", "range"], "left_anti")  # as many as there are ranges at most
        for b in sorted(r["bits"] for r in open_.select("bits").distinct().collect()):  # a row for each depth
            own = open_.where(F.col("bits") == b).select(F.col("range").alias("of"))
            inside = groups.join(F.broadcast(own), F.shiftright("h", 64 - b) == F.col("of"), "left_semi")
            kept = kept.unionByName(_ranges(inside, min(64, b + SPLIT_BITS)))
        atoms = durable(kept)


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, and the columns size, text_crc32, law, shard, slot and grown_shard put last."""
    names = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    own = others(docs, text_col, *names)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = durable(docs.select(
        packed(own).alias("own"), F.col(id_col).alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    ))
    _, cuts = group_cuts(durable(rows.groupBy("h").agg(F.sum("size").alias("bytes"))), shards)
    rows = rows.withColumns({"cell": F.shiftright("h", 64 - CELL_BITS).cast("int"), "shard": sum(((F.col("h") > F.lit(e)).cast("int") for e in cuts[:-1]), F.lit(0))})
    parts = F.ceil(F.col("n") / F.greatest(F.lit(float(RANKED)), F.sqrt("n"))).cast("int")
    by_shard = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = durable(rows.groupBy("cell", "shard").agg(F.count("*").alias("n"))).select(  # a row for each cell, and one more for each cut
        "cell", "shard", parts.alias("parts"), F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("offset"))
    dealt = rows.join(F.broadcast(placed), ["cell", "shard"]).withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts"))).otherwise(0).cast("int"))
    in_cell = Window.partitionBy("cell", "shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.where(F.col("parts") > 1).groupBy("cell", "shard", "part").agg(F.count("*").alias("n"))
        .select("cell", "shard", "part", F.coalesce(F.sum("n").over(in_cell), F.lit(0)).alias("ahead"))
    )
    in_part = Window.partitionBy("cell", "shard", "part").orderBy("id", "size", "text_crc32")
    return (
        dealt.withColumn("rank", F.row_number().over(in_part))
        .join(offsets, ["cell", "shard", "part"], "left")
        .select(
            *unpacked("own", own), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.coalesce(F.col("ahead"), F.lit(0)) + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
