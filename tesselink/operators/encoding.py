"""Difference keys of token lists, and statistics of the tokens they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from .cut import side

WEIGHT, SUPPORT = 20.0, 5


LIST_KEYS = ("x_extra", "x_missing", "x_aextra", "x_amissing")
SCALAR_KEYS = ("x_legal", "x_swap", "x_city")


def differences(a: Column, b: Column) -> dict[str, Column]:
    """From two token lists: extra (b only), missing (a only), and swap 'missing>extra' if there is one of each.

    An empty text has one empty token; who counts or encodes tokens leaves it out, ``word_rates`` does not.
    """
    extra, missing = F.array_except(b, a), F.array_except(a, b)
    return {"x_extra": extra, "x_missing": missing,
            "x_swap": F.when((F.size(extra) == 1) & (F.size(missing) == 1), F.concat(F.get(missing, F.lit(0)), F.lit(">"), F.get(extra, F.lit(0))))}


def te_keys(pairs: DataFrame) -> DataFrame:
    """``pairs`` (both sides' forms attached) with the seven keys whose rates are encoded.

    Name tokens of one side only and their swap, the change of the legal form, address words of one side only, and the
    change of the city where both name one.
    """
    plain = lambda c: F.filter(F.split(c, " "), lambda t: ~t.rlike("^[0-9]+$"))
    a1, a2 = plain("a_tok1"), plain("a_tok2")
    legal = lambda n: F.coalesce(F.col(f"n_legal{n}"), F.lit(""))
    moved = (F.col("a_city1") != F.col("a_city2")) & (F.col("a_city1") != "") & (F.col("a_city2") != "")
    return pairs.withColumns(differences(F.split("n_core1", " "), F.split("n_core2", " ")) | {
        "x_legal": F.concat(legal(1), F.lit(">"), legal(2)), "x_aextra": F.array_except(a2, a1), "x_amissing": F.array_except(a1, a2),
        "x_city": F.when(moved, F.concat("a_city1", F.lit(">"), "a_city2"))})


def _tokens(tokens: str) -> Column:
    """The tokens that count, one a row."""
    return F.explode(F.filter(tokens, lambda t: t != "")).alias("token")


def te_table(rows: DataFrame, token: str = "token", y: str = "y", by: tuple[str, ...] = (), prior: float | None = None) -> DataFrame:
    """Smoothed rate of each token: (sum y + 20 prior) / (n + 20), and n; the prior is the mean of y unless given."""
    base = rows.agg(F.avg(y)).first()[0] if prior is None else prior
    return rows.groupBy(*by, token).agg(((F.sum(y) + WEIGHT * F.lit(base)) / (F.count("*") + WEIGHT)).alias("rate"), F.count("*").alias("n"))


def te_out_of_fold(pairs: DataFrame, tokens: str, *, key: tuple[str, str] = ("rec_id", "s1_id"), y: str = "y", fold: str = "fold", name: str = "te") -> DataFrame:
    """min, max, mean and least support of the tokens' rates, without the pair's own fold, and how many are unseen.

    Totals less a fold's own give all folds in one pass.  A token that no other fold has stays missing, it
    does not fall back to the prior; a pair without tokens has nulls and counts of 0.
    """
    rates = side(_rates_out_of_fold(pairs.select(fold, y, _tokens(tokens)), pairs, y, fold))
    return _told(pairs, pairs.select(*key, fold, _tokens(tokens)).join(rates, ["token", fold]), key, name)


def _rates_out_of_fold(long: DataFrame, pairs: DataFrame, y: str, fold: str) -> DataFrame:
    """(token, fold, rate, n) of rows (token, fold, y): what the other folds say, nulls where they have none."""
    own = long.groupBy("token", fold).agg(F.sum(y).alias("ys"), F.count("*").alias("ns"))
    all_ = own.groupBy("token").agg(F.sum("ys").alias("yt"), F.sum("ns").alias("nt"))
    prior_own = pairs.groupBy(fold).agg(F.sum(y).alias("py"), F.count("*").alias("pn"))
    totals = pairs.agg(F.sum(y).alias("ay"), F.count("*").alias("an")).first()
    n = F.col("nt") - F.col("ns")
    prior = (F.lit(totals["ay"]) - F.col("py")) / (F.lit(totals["an"]) - F.col("pn"))
    return own.join(all_, "token").join(F.broadcast(prior_own), fold).select(  # a row for each fold
        "token", fold, F.when(n > 0, (F.col("yt") - F.col("ys") + WEIGHT * prior) / (n + WEIGHT)).alias("rate"), F.when(n > 0, n).alias("n"))


def _told(pairs: DataFrame, long: DataFrame, key, name: str) -> DataFrame:
    """``pairs`` with what the rates of their tokens (``long``) come to."""
    stats = long.groupBy(*key).agg(
        F.min("rate").alias(f"{name}_min"), F.max("rate").alias(f"{name}_max"), F.avg("rate").alias(f"{name}_mean"), F.min("n").alias(f"{name}_cnt"),
        F.count("*").alias(f"{name}_n"), F.sum(F.col("rate").isNull().cast("int")).alias(f"{name}_unseen"))
    return pairs.join(stats, list(key), "left").na.fill(0, [f"{name}_n", f"{name}_unseen"])


def te_scalar_out_of_fold(pairs: DataFrame, column: str, *, y: str = "y", fold: str = "fold", name: str = "te") -> DataFrame:
    """The rate of a scalar key without the pair's own fold: -1 where there is no key, null where no other fold has it; and its support."""
    keyed = pairs.where(F.col(column).isNotNull() & (F.col(column) != "")).select(fold, y, F.col(column).alias("token"))
    return _scalar(pairs, side(_rates_out_of_fold(keyed, pairs, y, fold)).withColumnRenamed("token", column), [column, fold], column, name)


def te_scalar_apply(pairs: DataFrame, column: str, table: DataFrame, *, name: str = "te") -> DataFrame:
    """The same from a table of rates (token, rate, n)."""
    return _scalar(pairs, side(table.select(F.col("token").alias(column), "rate", "n")), [column], column, name)


def _scalar(pairs, rates, on, column, name):
    out = pairs.join(rates, on, "left")
    return out.withColumns({name: F.when(F.col(column).isNull(), -1.0).otherwise(F.col("rate")), f"{name}_cnt": F.coalesce("n", F.lit(0))}).select(*pairs.columns, name, f"{name}_cnt")


def te_features(pairs: DataFrame, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """The features of all seven keys, out of fold, or from ``tables`` (a table of rates for each key)."""
    for c in LIST_KEYS:
        pairs = te_out_of_fold(pairs, c, name=f"te_{c}", **args) if tables is None else te_apply(pairs, c, tables[c], name=f"te_{c}")
    for c in SCALAR_KEYS:
        pairs = te_scalar_out_of_fold(pairs, c, name=f"te_{c}", **args) if tables is None else te_scalar_apply(pairs, c, tables[c], name=f"te_{c}")
    return pairs


def te_tables(pairs: DataFrame, y: str = "y") -> dict[str, DataFrame]:
    """The table of rates of each key, from all of ``pairs``; the prior is the mean of all."""
    prior = pairs.agg(F.avg(y)).first()[0]
    rows = {c: pairs.select(y, _tokens(c)) for c in LIST_KEYS} | {c: pairs.select(y, F.col(c).alias("token")).where("token <> ''") for c in SCALAR_KEYS}
    return {c: te_table(r, y=y, prior=prior) for c, r in rows.items()}


def te_apply(pairs: DataFrame, tokens: str, table: DataFrame, *, key: tuple[str, str] = ("rec_id", "s1_id"), name: str = "te") -> DataFrame:
    """The same features from a table of rates (token, rate, n)."""
    return _told(pairs, pairs.select(*key, _tokens(tokens)).join(side(table), "token", "left"), key, name)


def mask(rows: DataFrame, when: Column, name: str = "te") -> DataFrame:
    """Vocabulary features hidden where ``when`` holds: all tokens count as unseen; a scalar -1 (key absent) stays."""
    hidden = {f"{name}_{s}": F.when(~when, F.col(f"{name}_{s}")) for s in ("min", "max", "mean", "cnt")}
    return rows.withColumns(hidden | {f"{name}_unseen": F.when(when, F.col(f"{name}_n")).otherwise(F.col(f"{name}_unseen"))})


def mask_all(rows: DataFrame, when: Column, readers: tuple[str, ...] = ()) -> DataFrame:
    """All features that depend on the vocabulary hidden where ``when`` holds, the scores of ``readers`` and their context among them.

    ``when`` may be a block without labels, or a share of the entities at fitting (``simulate.draw``).
    """
    for c in LIST_KEYS:
        if f"te_{c}_n" in rows.columns:
            rows = mask(rows, when, f"te_{c}")
    hidden = {}
    for c in SCALAR_KEYS:
        if f"te_{c}" in rows.columns:
            v = F.col(f"te_{c}")
            hidden |= {f"te_{c}": F.when(~when | (v == -1), v), f"te_{c}_cnt": F.when(when, 0).otherwise(F.col(f"te_{c}_cnt"))}
    own = [c for r in readers for c in (r, f"{r}_gap", f"{r}_rank", f"{r}_margin") if c in rows.columns]
    return rows.withColumns(hidden | {c: F.when(~when, F.col(c)) for c in own})


def leave_one_out(rows: DataFrame, by: list[str], flag: str, valid: str, *, least: int = SUPPORT) -> DataFrame:
    """Share of ``flag`` among the other valid rows of the group (null under ``least`` of them), ``loo_n`` of them, and ln(1 + loo_n).

    ``flag`` and ``valid`` are 0 or 1; a row that is not valid counts for none, but has the share of those that are.
    """
    sums = side(rows.groupBy(*by).agg(F.sum(flag).alias("__s"), F.sum(valid).alias("__n")))
    n = F.col("__n") - F.col(valid)
    return rows.join(sums, by).withColumns({"loo_share": F.when(n >= least, (F.col("__s") - F.col(flag)) / n), "loo_n": n, "loo_logn": F.log1p(n.cast("double"))}).drop("__s", "__n")


def token_house_stats(pairs: DataFrame, *, key: tuple[str, str] = ("rec_id", "s1_id"), block: str = "block", house: str = "hnr_eq", least: int = SUPPORT) -> DataFrame:
    """ts_ex_hn_* and ts_mi_hn_*: least, largest and mean leave-one-out share of equal house numbers among the block's pairs
    that add (drop) the pair's tokens, and ln(1 + the least number of such pairs)."""
    for c, name in (("x_extra", "ts_ex"), ("x_missing", "ts_mi")):
        long = pairs.select(*key, block, _tokens(c), (F.col(house) >= 0).cast("int").alias("v"), (F.col(house) == 1).cast("int").alias("e"))
        stats = leave_one_out(long, [block, "token"], "e", "v", least=least).groupBy(*key).agg(
            F.min("loo_share").alias(f"{name}_hn_min"), F.max("loo_share").alias(f"{name}_hn_max"), F.avg("loo_share").alias(f"{name}_hn_mean"), F.log1p(F.min("loo_n").cast("double")).alias(f"{name}_hn_logn"))
        pairs = pairs.join(stats, list(key), "left")
    return pairs


def word_rates(pairs: DataFrame, least: int = 20) -> DataFrame:
    """(block, w, n, rate): of the pairs that add a word (the empty one of an empty name too) and have both house numbers, the share with equal ones."""
    long = pairs.where("hnr_eq >= 0").select("block", F.explode("x_extra").alias("w"), "hnr_eq")
    return long.groupBy("block", "w").agg(F.count("*").alias("n"), F.avg((F.col("hnr_eq") == 1).cast("int")).alias("rate")).where(F.col("n") >= least)


def token_features(pairs: DataFrame, frequency: DataFrame, *, key: tuple[str, str] = ("rec_id", "s1_id"), block: str = "block") -> DataFrame:
    """tk_ex_df_* and tk_mi_df_*: least and largest ldf (0 if unknown) of the tokens that the record adds and drops, and
    tk_swap_sim, how alike the two tokens of a swap are (-1 without one).  ``frequency``: (block, token, ldf)."""
    known = side(frequency)
    for c, name in (("x_extra", "tk_ex"), ("x_missing", "tk_mi")):
        long = pairs.select(*key, block, _tokens(c)).join(known, [block, "token"], "left")
        ldf = F.coalesce("ldf", F.lit(0.0))
        pairs = pairs.join(long.groupBy(*key).agg(F.min(ldf).alias(f"{name}_df_min"), F.max(ldf).alias(f"{name}_df_max")), list(key), "left")
    swap = F.coalesce("x_swap", F.lit(""))
    like = similarity.column("jaro_winkler", F.substring_index(swap, ">", 1), F.regexp_extract(swap, ">(.*)$", 1))
    return pairs.withColumn("tk_swap_sim", F.when(swap == "", -1.0).otherwise(like))


def token_frequency(rows: DataFrame, tokens: str) -> DataFrame:
    """(block, token, ldf): ln(1 + number of ids of the block that have the token)."""
    return rows.select("block", "id", F.explode(tokens).alias("token")).distinct().groupBy("block", "token").agg(F.log1p(F.count("*").cast("double")).alias("ldf"))


def name_frequency(rows: DataFrame) -> DataFrame:
    """(key, n_s1, n_rec) of rows (key, src); src 1 are the entities."""
    return rows.where("key is not null").groupBy("key").agg(F.count_if(F.col("src") == 1).alias("n_s1"), F.count_if(F.col("src") != 1).alias("n_rec"))


def attach_name_frequency(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """fq1_s1, fq1_rec, fq2_s1, fq2_rec: how many entities and records share the entity's (1) and the record's (2) name key.

    ``rows``: (id, key, src).  A side without a key has nulls.
    """
    counts = name_frequency(rows)
    for n, c in ((1, "s1_id"), (2, "rec_id")):
        of = rows.where("key is not null").select(F.col("id").alias(c), "key").join(counts, "key").select(c, F.col("n_s1").alias(f"fq{n}_s1"), F.col("n_rec").alias(f"fq{n}_rec"))
        pairs = pairs.join(of, c, "left")
    return pairs
