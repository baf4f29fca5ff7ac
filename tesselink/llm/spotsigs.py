"""SpotSigs fingerprints: chains of content words that follow common-word anchors, compared by pruned Jaccard.

A text is lower-cased and its white space reduced to single blanks and line breaks.  Every common word, and
every start of a line, is an anchor; with the up to ``CHAIN`` = 3 content words that follow it before the next
anchor it makes a spot.  The fingerprint is the set of the spots' 32-bit hashes.  Line starts count as anchors
so that texts without common words have a fingerprint too.

``whole`` spots, those of the query, hold every word of the text: a common word is an anchor with punctuation or
symbols around it too, the word after a full chain is an anchor of its own, and an anchor that no content word
follows is a spot by itself.

``near_pairs`` joins sets of a likeness of at least a threshold: sets are partitioned by length, in ranges
whose bounds grow by 1 / threshold, so that a set meets only its own and the next range; within a range two
sets meet when they share one of the rarest spots of both (prefix filter), and the exact likeness decides.

Defined cases: null counts as the empty text, whose set is empty; two empty sets are alike (1.0); spots are
a set, so repeats and their order do not count; texts of any length are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .wordlists import COMMON, any_of

CHAIN = 3
ANCHORS = sorted({w for words in COMMON.values() for w in words})
_MARK = "\u0001"
#: Ids are ordered within quantile ranges; the bounds of the ranges are the only values that reach the driver.
RANGES = 256


def spots(text: Column, chain: int = CHAIN, whole: bool = False) -> Column:
    """Sorted array<int> of the distinct spot hashes; ``whole``: each word is in one of the spots."""
    line = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D\x01]*\n[\x20\x09-\x0D\x01]*", "\n")
    line = F.regexp_replace(line, r"[\x20\x09\x0B-\x0D\x01]{2,}|[\x09\x0B-\x0D\x01]", " ")
    around = r"[\p{P}\p{S}]*+" if whole else ""
    marked = F.regexp_replace(F.trim(line) if whole else line, f" (?={around}(?:{any_of(ANCHORS)}){around}(?:[ \\n]|$))", _MARK)
    marked = F.concat(F.lit("^ "), F.replace(marked, F.lit("\n"), F.lit(_MARK + "^ ")))
    if whole:  # a match begins where a word does, so that long words are read once
        marked = F.regexp_replace(marked, rf"(?<![^ \x01])([^ \x01]++(?: [^ \x01]++){{{chain}}}) ", "$1" + _MARK)
        spot = F.filter(F.split(marked, _MARK), lambda s: (s != "") & (s != "^ "))
    else:
        spot = F.transform(F.filter(F.split(marked, _MARK), lambda s: (F.instr(s, " ") > 0) & (s != "^ ")), lambda s: F.substring_index(s, " ", chain + 1))
    hashed = F.transform(spot, lambda s: F.shiftright(F.xxhash64(s), 32).cast("int"))
    return F.array_sort(F.array_distinct(hashed))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 without counting where their lengths alone keep it under ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < least * large), 0.0)
        .otherwise(both / (small + large - both))
    )


def written(spot: Column) -> Column:
    """A set as a string: eight hex digits for each spot, in order."""
    return F.lower(F.array_join(F.transform(spot, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def near_pairs(sets: DataFrame, threshold: float = 0.8, *, id_col: str = "id", set_col: str = "spots") -> DataFrame:
    """(a, b, likeness) with a < b for all sets of a likeness of at least ``threshold``.

    Sets that are equal are joined once, by the smallest id of each; ``members`` of the result's two sides are
    found by joining on the set.  Empty sets pair with nothing.
    """
    rows = durable(
        sets.where(F.size(set_col) > 0).groupBy(F.col(set_col).alias("s")).agg(F.min(id_col).alias("id"))
        .withColumn("n", F.size("s")))
    often = rows.select(F.explode("s").alias("spot")).groupBy("spot").agg(F.count("*").alias("often"))
    spread = rows.select("id", "n", F.explode("s").alias("spot")).join(often, "spot")
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "spot"))
    prefix = (
        spread.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1)
        .withColumn("range", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)))
    near = prefix.select("id", "n", "spot", "place", F.explode(F.array("range", F.col("range") + 1)).alias("range"))
    a = near.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), "spot", "range")
    b = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), "spot", "range")
    fits = (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (
        F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb") >= F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9))
    met = a.join(b, ["spot", "range"]).where((F.col("a") != F.col("b")) & fits)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (rows.select(F.col("id").alias(x), F.col("s").alias("s" + x)) for x in "ab")
    return (
        met.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"), threshold))
        .where(F.col("likeness") >= threshold).select("a", "b", "likeness"))


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, h, n, next_id, next_h): for each distinct (doc_id, h), the next in descending order; the last has the first.

    Rows are ordered within quantile ranges of the id, at most ``RANGES``, and ranges are linked by their ends.
    """
    marks = ids.agg(F.percentile_approx("doc_id", [k / RANGES for k in range(1, RANGES)], 10_000).alias("m")).first()["m"] or []
    bounds = sorted(set(marks))
    at = F.coalesce(F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in bounds]), lambda b: b <= F.col("doc_id"))), F.lit(-1)) if bounds else F.lit(0)
    ranged = ids.withColumn("range", at)
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    own = F.struct("doc_id", "h")
    ends = ranged.groupBy("range").agg(F.max(own).alias("head"))
    over = Window.orderBy(F.col("range").desc())
    ends = ends.select("range", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("then"))  # at most RANGES + 1 rows
    linked = ranged.withColumn("next", F.lead(own).over(order)).join(F.broadcast(ends), "range")
    then = F.coalesce("next", "then")
    return linked.select("doc_id", "h", "n", then["doc_id"].alias("next_id"), then["h"].alias("next_h"))


def edited_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last third of the code points replaced by as many from the start of the next
    document in descending id order (after the last, the first).  Only ids and lengths are ordered; the texts
    move once by id, and each third once more.  Rows that repeat id and text count as one document for "next".
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    narrow = durable(texts.select("doc_id", "h", F.length("text").cast("long").alias("n")))
    ids = narrow.distinct()
    rows = narrow.count()
    order = durable(following(ids), rows)
    repeated = rows > order.count()
    wanted = order.select(F.col("next_id").alias("id2"), F.col("next_h").alias("h2"), F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    match = texts["doc_id"].eqNullSafe(wanted["id2"]) & (texts["h"] == wanted["h2"])
    heads = texts.join(wanted.hint("shuffle_hash"), match).select(
        "for_id", "for_h", "k", F.substring(F.col("text"), F.lit(1), F.col("k")).alias("head"), spots(F.col("text"), whole=True).alias("next_spots"))
    if repeated:
        heads = heads.dropDuplicates(["for_id", "for_h"])
    found = texts["doc_id"].eqNullSafe(heads["for_id"]) & (texts["h"] == heads["for_h"])
    n = F.length("text")
    joined = texts.join(heads, found).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - F.col("k")), F.col("head")))
    signed = joined.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        spots(F.col("text"), whole=True).alias("own"), spots(F.col("edited"), whole=True).alias("changed"), "next_spots")
    return signed.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_spots")).alias("near_next"))
