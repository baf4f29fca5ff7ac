"""Quality rules: repetition counts, and the divergence of a document's histograms from its language's.

The base counts are exact.  Repeated 8-word windows are found inside the row: word hashes are paired three
times (1, 2 and 4 apart) to window hashes, and only in texts where those are not distinct they are sorted, so
that neighbours show the repeats.  Memory and time follow the text, not its square.

The verdict compares two histograms of a document, over character classes and over its language's common
words, to those of all documents of the language by Jensen-Shannon distance (base 2, in 0..1).  Texts under
the minimum length are not judged by a histogram.

Defined cases: null text has no words and fails the base; a language without a word list is judged by
character classes alone; a null language is a language of its own; a histogram without entries is not judged;
further columns pass through, whatever their names, except that those it adds are replaced; repeated rows are
judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, others, packed, unpacked, words
from .wordlists import COMMON

WINDOW = 8
#: Class name, pattern of its characters.
CLASSES = (
    ("lower", "[a-z]"), ("upper", "[A-Z]"), ("digit", "[0-9]"), ("blank", r"[\x20\x09-\x0D]"),
    ("stop", "[.,;:!?'\"()\\-]"), ("symbol", "[#*$%&|<>@=+/_~^{}\\[\\]\\\\`]"),
)
MIN_CHARS, MIN_WORDS = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.65
BROADCAST_LANGUAGES = 20_000


def _paired(h: str, apart: int) -> Column:
    """Hashes of each element with the one ``apart`` further on."""
    col = F.col(h)
    return F.transform(F.slice(col, F.lit(1), F.greatest(F.size(col) - apart, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(col, i + apart)))


def _repeat_words(h: str) -> Column:
    """Words covered by windows (their hashes in order: ``h``) that occur at least twice."""
    col = F.col(h)
    placed = F.array_sort(F.transform(col, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(col) > F.size(F.array_distinct(col)), placed)


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``__words``, the lower-cased common words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumns({"__tokens": words(F.col(text_col)), "__lines": lines})
    common = sorted({w for x in COMMON.values() for w in x})
    longest = max(len(w.encode()) for w in common)
    rows = rows.withColumns({
        "n_words": F.size("__tokens").cast("long"),
        "word_chars": F.length(F.array_join("__tokens", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__words": F.filter(F.transform(F.filter("__tokens", lambda w: F.octet_length(w) <= longest), lambda w: F.lower(w)), lambda w: w.isin(common)),
        "__h": F.transform("__tokens", lambda w: F.xxhash64(w)),
    }).drop("__tokens", "__lines")
    for apart in (1, 2, 4):
        rows = rows.withColumn("__h", _paired("__h", apart))
    rows = rows.withColumn("__placed", _repeat_words("__h")).drop("__h")
    s = F.col("__placed")
    twice = F.filter(
        F.transform(s, lambda e, k: F.when((e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"]), e["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("__at", F.array_sort(twice)).drop("__placed")
    at = F.col("__at")
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")), lambda a, i: F.struct(
        (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__at")


def class_counts(text: Column) -> Column:
    """Array<long>: characters of each class, then all others."""
    text = F.coalesce(text, F.lit(""))
    counts = [F.length(text) - F.length(F.regexp_replace(text, p + "+", "")) for _, p in CLASSES]
    return F.array(*[c.cast("long") for c in counts], F.length(text).cast("long"))


def common_counts(found: Column, lang: Column) -> Column:
    """Array<long>: occurrences of each common word of the language; null without a list for it."""
    lists = [(F.lit(k), F.array(*map(F.lit, v))) for k, v in COMMON.items()]
    own = F.lit(None).cast("array<string>")
    for name, value in lists:
        own = F.when(lang == name, value).otherwise(own)
    return F.transform(own, lambda w: F.size(F.filter(found, lambda x: x == w)).cast("long"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two count arrays; null if either is empty or null."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    tp, tq = total(p), total(q)
    terms = F.zip_with(p, q, lambda x, y: part(x / tp, (x / tp + y / tq) / 2) + part(y / tq, (x / tp + y / tq) / 2))
    return F.when((tp > 0) & (tq > 0), F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(terms) / 2))))


def _others(counts: Column) -> Column:
    """Class counts whose last entry, all characters, becomes the characters of no class."""
    n = len(CLASSES)
    named = F.slice(counts, 1, n)
    return F.concat(named, F.array(F.get(counts, F.lit(n)) - F.aggregate(named, F.lit(0).cast("long"), lambda s, x: s + x)))


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
          min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the text, with the base counts, base_failed, char_distance, word_distance and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    own = others(docs, text_col, *names)
    rows = docs.select(packed(own).alias("__own"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    counted = base_counts(rows, "__text").withColumn("__counts", class_counts(F.col("__text")))
    base = counted.select(  # __counts is named more than once, so it stays a column and is worked out once
        "__own", *names[:5], "__lang", _others(F.col("__counts")).alias("__chars"), common_counts(F.col("__words"), F.col("__lang")).alias("__common"))
    rows = durable(base)
    width, most = len(CLASSES) + 1, max(map(len, COMMON.values()))
    summed = lambda name, n: F.array(*[F.coalesce(F.sum(F.get(F.col(name), F.lit(i))), F.lit(0)) for i in range(n)])
    of_lang = rows.groupBy("__lang").agg(summed("__chars", width).alias("__all_chars"), summed("__common", most).alias("__all_common"))
    of_lang = durable(of_lang.withColumnRenamed("__lang", "__of"))
    if of_lang.count() <= BROADCAST_LANGUAGES:  # measured
        of_lang = F.broadcast(of_lang)
    word_total = F.slice(F.col("__all_common"), F.lit(1), F.greatest(F.size("__common"), F.lit(1)))
    joined = rows.join(of_lang, F.col("__lang").eqNullSafe(F.col("__of")))
    n_chars = F.aggregate("__chars", F.lit(0).cast("long"), lambda s, x: s + x)
    return joined.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "char_distance": F.when(n_chars >= min_chars, js_distance(F.col("__chars"), F.col("__all_chars"))),
        "word_distance": F.when(F.col("n_words") >= min_words, js_distance(F.col("__common"), word_total)),
    }).withColumn("kept", ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= max_char) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)).select(*unpacked("__own", own), *names)
