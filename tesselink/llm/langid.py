"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of up to ``per_language`` documents of each language (a bounded sample by a hash
of the id; their whole texts count) and of no other rows than those with a label.  The log-probability matrix
has a fixed number of rows and is broadcast after its size is checked.  Scoring looks up the rows of a batch's
n-grams and sums them by document; long texts are read in blocks, so memory does not follow their length.  The
counts that reach the driver are at most one for each language and row of the matrix; their size is checked as well.

Defined cases: null text or a text without a letter is ``und`` with score 0; rows of null label are not learned;
without any labelled row all is ``und``; ties go to the first language in order; repeated rows are scored alike;
empty tables give empty results; rows of null id are learned and scored like others (``held_out`` is false for
them); further columns pass through, whatever their names, except lang_pred and score, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, packed, unpacked

ORDERS, BITS = (1, 2, 3), 14
ROWS = len(ORDERS) << BITS
PER_LANGUAGE = 2000
MAX_LANGUAGES = 2048
#: Bytes of a count (language, row, n) that is collected: more than those of the matrix and of a worker's counts.
_COUNT_BYTES = 20
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_BLOCK = 1 << 18


def _grams(text: str) -> Iterator[np.ndarray]:
    """Rows of the n-grams of a text without its non-letters, block by block; nothing if it has no letter."""
    clean = _OTHER.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, clean)):  # what is left may be other numbers, such as superscripts
        return
    points = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    reach = max(ORDERS) - 1
    for at in range(0, len(points), _BLOCK):
        part = points[at : at + _BLOCK + reach]
        h, found = np.zeros(len(part), np.uint32), []
        for k, n in enumerate(ORDERS):
            h = (h[: len(part) - n + 1] * np.uint32(0x01000193)) ^ part[n - 1 :] * np.uint32(0x9E3779B1)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            found.append((mixed[:_BLOCK] >> np.uint32(32 - BITS)).astype(np.int32) + (k << BITS))
        yield np.concatenate(found)


def _count(batches):
    """(lang, row, n) of a partition."""
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            own = counts.setdefault(lang, np.zeros(ROWS, np.int64))
            for rows in _grams(text):
                own += np.bincount(rows, minlength=ROWS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "row", "n"])


class Model:
    """Languages in order, and for each n-gram row their log-probabilities; ``prior``: of the languages."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts), bool)
        held, of, size = [], [], 0

        def flush():
            nonlocal held, of, size
            if held:
                starts = np.cumsum([0] + [len(x) for x in held[:-1]])
                np.add.at(total, of, np.add.reduceat(self.matrix[np.concatenate(held)], starts, axis=0, dtype=np.float64))
            held, of, size = [], [], 0

        for k, text in enumerate(texts if self.languages else ()):
            for rows in _grams(text) if text else ():
                letters[k] = True
                held.append(rows)
                of.append(k)
                size += len(rows)
                if size >= _BLOCK:
                    flush()
        flush()
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total += self.prior
        total -= total.max(axis=1, keepdims=True)
        share = np.exp(total)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return (
            [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)],
            [float(share[k, b]) if ok else 0.0 for k, (b, ok) in enumerate(zip(best, letters))],
        )


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
          smoothing: float = 0.5, most_bytes: int = 1 << 28) -> Model:
    """A model of the rows whose label is not null; at most about ``per_language`` of each language are read."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES or len(sizes) * ROWS * _COUNT_BYTES > most_bytes:
        raise ValueError(f"{len(sizes)} languages: the matrix is too large to broadcast")
    if not sizes:
        return Model([], np.zeros((ROWS, 0), np.float32), np.zeros(0))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    draw = F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = rows.where(F.col("text").isNotNull() & (draw < share[F.col("lang")])).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, row int, n long").groupBy("lang", "row").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(r["lang"] for r in sizes)
    table = np.zeros((ROWS, len(languages)))
    table[counts["row"].to_numpy(), counts["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(dtype=int)] = counts["n"].to_numpy()
    seen = table.reshape(len(ORDERS), -1, len(languages))  # a distribution for each order
    seen = np.log((seen + smoothing) / (seen.sum(axis=1, keepdims=True) + smoothing * seen.shape[1]))
    prior = np.array([dict((r["lang"], r["count"]) for r in sizes)[x] for x in languages], float)
    return Model(languages, seen.reshape(ROWS, -1).astype(np.float32), np.log(prior / prior.sum()))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.score([x if isinstance(x, str) else None for x in text])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    udf = F.pandas_udf(predict, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    own = others(docs, "lang_pred", "score")
    found = docs.select(packed(own).alias("own"), udf(F.col(text_col)).alias("found"))
    return found.select(*unpacked("own", own), "found.lang_pred", "found.score")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
