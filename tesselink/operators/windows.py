"""Context and group features of candidate pairs: windows over the records' and the entities' sides.

Ties in a rank go by the other side's id.  All frames are whole partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import side


def rec():
    return Window.partitionBy("rec_id")


def ent():
    return Window.partitionBy("s1_id")


def _rank(over, score: str, tie: str) -> Column:
    return F.row_number().over(over.orderBy(F.col(score).desc_nulls_last(), tie))


#: A record's pairs are dealt into so many parts for each wanted row; the parts' best scores bound what is ranked.
BOUND_PARTS = 4


def top(pairs: DataFrame, k: int, score: Column, tie: str = "s1_id", rank: str = "__rk") -> DataFrame:
    """The ``k`` rows of each record with the highest scores (nulls last), with ``rank``; ties go by ``tie``.

    The k-th best of the parts' best scores is at most the k-th best score, so that only the pairs that reach it are
    ranked: nothing is sorted but them, and pairs that stand by record are not moved.
    """
    x = pairs.withColumn("__score", score)
    part = F.pmod(F.hash(tie), F.lit(BOUND_PARTS * k)) if k > 1 else F.lit(0)
    peaks = x.where("__score is not null").select("rec_id", part.alias("__part"), "__score").groupBy("rec_id", "__part").agg(F.max("__score").alias("__peak"))
    bound = peaks.groupBy("rec_id").agg(F.get(F.sort_array(F.collect_list("__peak"), asc=False), F.lit(k - 1)).alias("__bound"))  # BOUND_PARTS * k values at most
    if k == 1:
        bound = peaks.select("rec_id", F.col("__peak").alias("__bound"))
    kept = x.join(bound.hint("shuffle_hash"), "rec_id", "left").where(F.col("__bound").isNull() | (F.col("__score") >= F.col("__bound")))
    return kept.withColumn(rank, _rank(rec(), "__score", tie)).where(F.col(rank) <= k).select(*pairs.columns, rank)


def context(pairs: DataFrame, p: str = "p") -> DataFrame:
    """c_rec_n, c_s1_n, c_rec_rank, c_rec_gap, c_s1_rank, c_s1_psum."""
    return pairs.withColumns({
        "c_rec_n": F.count("*").over(rec()), "c_s1_n": F.count("*").over(ent()), "c_rec_rank": _rank(rec(), p, "s1_id"), "c_rec_gap": F.max(p).over(rec()) - F.col(p),
        "c_s1_rank": _rank(ent(), p, "rec_id"), "c_s1_psum": F.sum(p).over(ent())})


def margin(pairs: DataFrame, score: str, name: str) -> DataFrame:
    """Of the best of a record: its lead on the second (0 if none); of others: their distance to the best, negative.

    Only a record's two best are ranked; they meet its pairs where these stand.
    """
    at = lambda k, c: F.max(F.when(F.col("__rk") == k, F.col(c)))
    two = top(pairs, 2, F.col(score), rank="__rk").groupBy("rec_id").agg(at(1, "s1_id").alias("__id"), at(1, score).alias("__best"), at(2, score).alias("__second"))
    x = pairs.join(two.hint("shuffle_hash"), "rec_id", "left")
    lone = pairs.where("rec_id is null").crossJoin(F.broadcast(two.where("rec_id is null").drop("rec_id")))  # a key that is null meets none
    x = x.where("rec_id is not null").unionByName(lone)
    first = F.col("s1_id").eqNullSafe(F.col("__id")) & F.col(score).eqNullSafe(F.col("__best"))
    lead = F.when(first, F.col(score) - F.coalesce("__second", F.lit(0.0))).otherwise(F.col(score) - F.col("__best"))
    return x.withColumn(name, lead).select(*dict.fromkeys([*pairs.columns, name]))


def strict_margin(pairs: DataFrame, score: str, prefix: str, absent: float = -20.0) -> DataFrame:
    """``prefix``_gap to the record's best, _rank, and _margin over the best value strictly below it (``absent`` if none)."""
    best = pairs.withColumn("__m", F.max(score).over(rec()))
    lower = F.coalesce(F.max(F.when(F.col(score) < F.col("__m"), F.col(score))).over(rec()), F.lit(absent))
    return best.withColumns({f"{prefix}_gap": F.col("__m") - F.col(score), f"{prefix}_rank": _rank(rec(), score, "s1_id"), f"{prefix}_margin": F.col(score) - lower}).drop("__m")


def group_features(pairs: DataFrame, p: str = "p") -> DataFrame:
    """The nine numeric group features; ``sib_id`` is the entity's best record other than the pair's own, if any."""
    x = pairs.withColumns({
        "g_rec_max": F.max(p).over(rec()), "g_rec_rank": _rank(rec(), p, "s1_id"), "g_rec_sum": F.sum(p).over(rec()), "g_s1_rank": _rank(ent(), p, "rec_id"), "g_s1_sum": F.sum(p).over(ent()),
        "g_s1_n50": F.sum((F.col(p) > 0.5).cast("int")).over(ent()), "g_s1_max": F.max(p).over(ent())})
    at = lambda rank, of, value, k: F.max(F.when(F.col(rank) == k, value)).over(of)
    other = F.coalesce(F.when(F.col("g_rec_rank") == 1, at("g_rec_rank", rec(), F.col(p), 2)).otherwise(F.col("g_rec_max")), F.lit(0.0))
    sib = F.struct(F.col(p).alias("p"), F.col("rec_id").alias("id"))
    sibling = F.when(F.col("g_s1_rank") == 1, at("g_s1_rank", ent(), sib, 2)).otherwise(at("g_s1_rank", ent(), sib, 1))
    return x.withColumns({"g_rec_other": other, "__sib": sibling}).withColumns({
        "g_rec_margin": F.col(p) - F.col("g_rec_other"), "g_sib_p": F.coalesce(F.col("__sib.p"), F.lit(0.0)), "sib_id": F.col("__sib.id")}).drop("__sib")


def twin_features(pairs: DataFrame, keys: DataFrame, p: str = "p", least: float = 0.5) -> DataFrame:
    """Records that share a name key: how many are assigned to the pair's entity, to others, to none.

    ``keys``: (rec_id, key).  A record is assigned to its best entity if that has at least ``least``.
    """
    best = pairs.withColumn("__rk", _rank(rec(), p, "s1_id")).where((F.col("__rk") == 1) & (F.col(p) >= least)).select("rec_id", F.col("s1_id").alias("to"))
    n = keys.groupBy("key").agg(F.count("*").alias("n"))
    assigned = keys.join(best, "rec_id")
    any_ = assigned.groupBy("key").agg(F.count("*").alias("any"))
    to = assigned.groupBy("key", F.col("to").alias("s1_id")).agg(F.count("*").alias("to_n"))
    x = pairs.join(keys, "rec_id").join(n, "key").join(any_, "key", "left").join(to, ["key", "s1_id"], "left").join(best, "rec_id", "left").na.fill(0, ["any", "to_n"])
    self_e, self_any = F.coalesce((F.col("to") == F.col("s1_id")).cast("int"), F.lit(0)), F.col("to").isNotNull().cast("int")
    x = x.withColumns({"tw_n": F.col("n") - 1, "tw_to_e": F.col("to_n") - self_e, "tw_to_other": F.col("any") - F.col("to_n") - (self_any - self_e)})
    return x.withColumn("tw_unassigned", F.col("tw_n") - F.col("tw_to_e") - F.col("tw_to_other")).select(*pairs.columns, "tw_n", "tw_to_e", "tw_to_other", "tw_unassigned")


def shift_ranks(pairs: DataFrame, deleted: DataFrame, rank: str = "rk", order: tuple = ()) -> DataFrame:
    """Pairs without those of ``deleted`` entities, ranks less by the deleted ones above them.

    ``order``: the columns by which the ranks were given, if at hand; pairs that stand in it are not sorted again.
    """
    marked = pairs.join(side(deleted.select("s1_id").distinct().withColumn("__gone", F.lit(1))), "s1_id", "left")
    above = F.sum(F.coalesce("__gone", F.lit(0))).over(rec().orderBy(*(order or (rank,))).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(rank, (F.col(rank) - above).cast("int")).where("__gone is null").select(*pairs.columns)


def retrieval_context(pairs: DataFrame) -> DataFrame:
    """The columns of the first stage that set a pair beside its record's and its entity's others.

    Takes cos_n, cos_a, q_nm_ts and q_ad_ts.  ``rec_max_``, ``gap_`` and ``marg_`` (over the best other one) for each
    view, ``gap2_c`` (the lead of the first on the second, else the distance to the first), and the entity's side.
    """
    x = pairs.withColumn("cos_c", F.col("cos_n") + F.col("cos_a"))
    x = x.withColumns({"rec_ncand": F.count("*").over(rec()), "rk_rec_c": _rank(rec(), "cos_c", "s1_id"), "__rk_n": _rank(rec(), "cos_n", "s1_id"), "__rk_a": _rank(rec(), "cos_a", "s1_id"),
                       "q_nm_gap": F.col("q_nm_ts") - F.max("q_nm_ts").over(rec()), "q_ad_gap": F.col("q_ad_ts") - F.max("q_ad_ts").over(rec())} | {f"rec_max_{v}": F.max(f"cos_{v}").over(rec()) for v in "cna"})
    second = lambda v, rank: F.coalesce(F.max(F.when(F.col(rank) == 2, F.col(f"cos_{v}"))).over(rec()), F.lit(0.0))
    x = x.withColumns({"__sec_c": second("c", "rk_rec_c"), "sec_n": second("n", "__rk_n"), "sec_a": second("a", "__rk_a"), "s1_nrec": F.count("*").over(ent()),
                       "s1_top1": F.sum((F.col("rk_rec_c") == 1).cast("int")).over(ent()), "s1_rank_c": _rank(ent(), "cos_c", "rec_id"), "s1_max_c": F.max("cos_c").over(ent())})
    lead = lambda v, rank, sec: F.col(f"cos_{v}") - F.when(F.col(rank) == 1, F.col(sec)).otherwise(F.col(f"rec_max_{v}"))
    x = x.withColumns({f"gap_{v}": F.col(f"cos_{v}") - F.col(f"rec_max_{v}") for v in "cna"} | {
        "gap2_c": lead("c", "rk_rec_c", "__sec_c"), "marg_n": lead("n", "__rk_n", "sec_n"), "marg_a": lead("a", "__rk_a", "sec_a"), "s1_gap_c": F.col("cos_c") - F.col("s1_max_c")})
    return x.drop("__rk_n", "__rk_a", "__sec_c")


def attach_reader(pairs: DataFrame, scores: DataFrame, name: str, score: str = "score") -> DataFrame:
    """``pairs`` with a reader's score (the largest, should a pair have several) as ``name`` and its gap, rank and margin; null where it has none."""
    return strict_margin(matched(pairs, scores.select("rec_id", "s1_id", F.col(score).alias(name)), name), name, name)


def matched(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """``pairs`` with the largest ``name`` that ``values`` (rec_id, s1_id, ``name``) has of them, else null.

    Pairs without further columns meet the values in one grouping by record and entity: sides that stand by record are
    not moved, which a join by both keys would do.
    """
    if {*pairs.columns} != {"rec_id", "s1_id"}:
        return pairs.join(values.groupBy("rec_id", "s1_id").agg(F.max(name).alias(name)), ["rec_id", "s1_id"], "left")
    rows = pairs.select("rec_id", "s1_id", F.lit(1).alias("__n"), F.lit(None).cast(values.schema[name].dataType).alias(name))
    met = rows.unionByName(values.select("rec_id", "s1_id", F.lit(0).alias("__n"), name)).groupBy("rec_id", "s1_id").agg(F.sum("__n").alias("__n"), F.max(name).alias("__v"))
    value = F.when(F.col("rec_id").isNotNull() & F.col("s1_id").isNotNull(), F.col("__v")).alias(name)
    again = F.explode(F.array_repeat(F.lit(1), F.col("__n").cast("int")))  # none for values without a pair
    return met.where("__n > 0").select("rec_id", "s1_id", value, again).select("rec_id", "s1_id", name)
