"""Mixing sources to target weights: Efraimidis-Spirakis order, prefix sums, token budgets.

Every document gets an exponential key ``-ln(U) / quality``; ascending keys are a weighted sample without
replacement.  A source's target is met by whole epochs first, then by its documents in key order until the
prefix sum of their words reaches the rest of the budget; the document at the cut gives its first words only.

No source is ever sorted as a whole.  The range of a source's keys, as measured, is cut into 2**10 cells, whose sums show
the one in which the budget ends; that cell's own range is cut again, four times in all, whatever the weights
are.  Only the last cell is sorted.

Defined cases: null or blank text has size 0 and gives 0 words; a null source is a source of its own, after
all others; a source without words has target 0; equal keys are ordered by id, size and source text hash;
repeated rows count as rows of their own; null ids share a draw; an empty table gives an empty result; further
columns pass through, whatever their names, except that those it adds are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, others, packed, unit_interval, unpacked, word_count

#: A plan of more sources than this is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 20_000
SEED = 17
#: Words that a text of full weight has at least, and its characters for each word.
USUAL_WORDS, USUAL_MEAN = 20, (3, 13)
CELLS, LEVELS = 1 << 10, 4
_P = "__mix_"


def text_quality(text: Column) -> Column:
    """A document's default weight: 1 for at least 20 words of usual mean length, else 1/2."""
    n = word_count(text)
    mean = F.length(text) / F.greatest(n, F.lit(1))
    return F.when((n >= USUAL_WORDS) & mean.between(*USUAL_MEAN), 1.0).otherwise(0.5)


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets by water-filling: ``share`` of all sizes by weight, no source above ``cap`` of its own size.

    ``sizes``: a row for each source, columns ``key``, ``source``, ``source_size``.  The level at which the
    excess of the capped sources has been dealt to the others is found by prefix sums in the order in which
    sources reach their cap.  There is one row for each source here, never one for each document.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "key")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("below", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("below")) / F.col("rest"))
        .withColumn("place", F.row_number().over(by_ratio))
    )
    free = F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))
    return ranked.withColumn("final", F.min(free).over(everything)["level"]).select(
        "key", "source", "source_size",
        F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("final"), F.col("most"))).alias("target"),
    )


def _boundary(narrow: DataFrame, bounds: DataFrame) -> DataFrame:
    """``bounds`` (key, budget, before, lo, hi: words ahead of the keys lo..hi, among which the budget ends) in finer steps.

    A source whose budget ends exactly where its rows do, or is 0, has no bounds.
    """
    of = bounds.select(F.col("key").alias("of"), "budget", "before", "lo", "hi")
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.lit(CELLS - 1), F.floor((F.col("order") - F.col("lo")) / width * CELLS))).otherwise(0)
    inside = narrow.join(of, F.col("key") == F.col("of")).where(F.col("order").between(F.col("lo"), F.col("hi"))).withColumn("cell", place.cast("int"))
    cells = inside.groupBy("key", "cell").agg(
        F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("before").alias("before"), F.min("order").alias("lo"), F.max("order").alias("hi"))
    ahead = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS rows of a source
    return (
        cells.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        .where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words")))
        .select("key", "budget", "before", "lo", "hi")
    )


def mix_plan(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, quality: Column | None = None,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """A row for each source: its size, target, whole epochs, and where in key order the fractional pass ends.

    Columns ``key, source_size, target, epochs, budget, before, lo, hi``: the pass ends among the keys lo..hi (null:
    takes nothing more), ``before`` are the words ahead of them.
    """
    narrow = durable(
        _keyed(docs, quality, id_col, text_col, source_col, seed).select(
            F.col(_P + "key").alias("key"), F.col(source_col).alias("source"), F.col(_P + "size").alias("size"), F.col(_P + "order").alias("order"))
    )
    sizes = narrow.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.min("order").alias("lo"), F.max("order").alias("hi"))
    goal = F.round("target").cast("long")
    targets = source_targets(sizes.drop("lo", "hi"), weights, share, cap).select("key", "source_size", "target")
    sources = durable(
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", goal - F.col("epochs") * F.col("source_size"))
        .join(sizes.select("key", "lo", "hi"), "key")
    )
    bounds = sources.select("key", "budget", F.lit(0).cast("long").alias("before"), "lo", "hi")
    few = sources.count() <= BROADCAST_SOURCES  # measured
    for _ in range(LEVELS):
        bounds = durable(_boundary(narrow, F.broadcast(bounds) if few else bounds))
    return sources.drop("lo", "hi").join(bounds.select("key", "before", "lo", "hi"), "key", "left")


def _keyed(docs, quality, id_col, text_col, source_col, seed):
    weight = text_quality(F.col(text_col)) if quality is None else quality
    weight = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-9))
    return docs.withColumns({
        _P + "size": word_count(F.col(text_col)),
        _P + "key": _source_key(F.col(source_col)),
        _P + "order": -F.log(unit_interval(F.lit(seed), F.col(id_col))) / weight,
    })


def mix(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, quality: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` with the columns size, source_size, target and taken (words, repeats counted) put last.

    Columns of ``docs`` with one of these names are replaced.
    """
    args = dict(quality=quality, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    plan = durable(mix_plan(docs, weights=weights, share=share, cap=cap, **args))
    plan = plan.select(*[F.col(c).alias(_P + ("plan_" if c == "key" else "") + c) for c in plan.columns])
    if plan.count() <= BROADCAST_SOURCES:  # measured, not assumed
        plan = F.broadcast(plan)
    own = others(docs, "size", "source_size", "target", "taken")
    col = lambda name: F.col(_P + name)
    # The text stays in the struct of own columns, once.
    docs = docs.select(packed(own).alias(_P + "own"), *([] if quality is None else [quality.alias(_P + "quality")]))
    args |= {k: f"{_P}own.{args[k]}" for k in ("id_col", "text_col", "source_col")} | ({} if quality is None else {"quality": col("quality")})
    rows = _keyed(docs, **args).join(plan, col("key") == col("plan_key"))
    at = F.coalesce(col("order").between(col("lo"), col("hi")), F.lit(False))
    clear = rows.where(~at).withColumn(_P + "extra", F.when(col("order") < col("lo"), col("size")).otherwise(0))
    order = Window.partitionBy(_P + "key").orderBy(_P + "order", args["id_col"], _P + "size", F.xxhash64(args["text_col"]))
    ahead = col("before") + F.coalesce(F.sum(_P + "size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = rows.where(at).withColumn(_P + "extra", F.greatest(F.lit(0), F.least(col("size"), col("budget") - ahead)))
    return clear.unionByName(edge).select(
        *unpacked(_P + "own", own), col("size").alias("size"), col("source_size").alias("source_size"), col("target").alias("target"),
        (col("epochs") * col("size") + col("extra")).cast("long").alias("taken"),
    )


def _passes(mixed: DataFrame, text: Column) -> tuple[DataFrame, Column]:
    """``mixed``, a row for each time that a document is taken, with its text as ``__mix_text``; and whether that is cut."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    tail = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    passes = F.concat(F.array_repeat(F.lit(0), whole), F.when(tail > 0, F.array(tail)).otherwise(F.array().cast("array<int>")))
    rows = mixed.withColumn(_P + "words", F.explode(passes))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), 1, F.col(_P + "words")), "")
    short = F.col(_P + "words") > 0
    return rows.withColumn(_P + "text", F.when(short, cut).otherwise(text)), short


def emit_mixed(mixed: DataFrame, columns: Sequence[str], text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of the mix: each document as often as it is taken whole, and once more cut to its remaining words.

    The cut keeps the white space between the words.  ``length_col``, if given, is set to the length of a cut text.
    """
    out, short = _passes(mixed, F.col(text_col))
    named = {text_col: F.col(_P + "text")} | ({length_col: F.when(short, F.length(_P + "text").cast("long")).otherwise(F.col(length_col))} if length_col else {})
    return out.select(*[named.get(c, F.col(c)).alias(c) for c in columns])


def mixed_rows(docs: DataFrame, *, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               length_col: str | None = None, **args) -> DataFrame:
    """The rows of the mix of ``docs``, all columns as they were but the text of a document that is cut, and its length."""
    rows = docs.select(packed(docs.columns).alias("row"), *([] if quality is None else [quality.alias("quality")]))
    mixed = mix(rows, quality=None if quality is None else F.col("quality"), id_col=f"row.{id_col}", text_col=f"row.{text_col}", source_col=f"row.{source_col}", **args)
    out, short = _passes(mixed, F.col("row").getField(text_col))
    own = {text_col: F.col(_P + "text")}
    if length_col:
        own[length_col] = F.when(short, F.length(_P + "text").cast("long")).otherwise(F.col("row").getField(length_col))
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
