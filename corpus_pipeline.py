"""A corpus pipeline: five stages over ``documents``, each one operator of ``tesselink.llm``.

Language identification drops documents without a language, near-duplicates leave one of each group, secrets are
replaced in the texts, sources are mixed to their target weights (a document taken twice is two rows, one cut at
its source's budget keeps its first words), and the last stage encodes every text and digests the ids.

Defined cases, for every stage: ids, texts, languages and sources may be null, and ids may repeat; texts of any length are
read whole; an empty table gives an empty result with the same columns; further columns pass through all stages but the
last, whatever their names.  What a stage does beyond that its docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselink.llm import bpe, langid, mixing, secrets, simhash
from tesselink.llm.common import durable, packed, table, unpacked
from tesselink.llm.queries import vocabulary


#: Pieces that a worker remembers: Python workers live through all stages beside the executor's full heap.
REMEMBERED = 1 << 15
#: Rows that a task sends to its Python worker at once, at most: their texts stand several times over beside the full heap.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ``BATCH_ROWS``; what a stage returns is planned later, so that the setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:  # 0 or less: no bound
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language stay; the model learns from all rows but the held-out quarter.

    A null text and one without a letter have none; without any row to learn from no document has.  A null id is not
    held out.  Repeated rows stay or go together.
    """
    small_batches(spark)
    known = docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    rows = docs.select(packed(docs.columns).alias("row"))
    found = langid.identify(rows, langid.train(known), text_col="row.text")
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*unpacked("row", docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest id (null last).

    Null and empty texts are alike; of repeated rows one stays.
    """
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, their secrets, whole private keys among them, replaced and n_chars with them; a null text stays null."""
    return secrets.redact(docs, rules=secrets.WHOLE, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: a document as often as it is taken, n_chars following a cut.

    A null source is a source; texts without words are not taken; repeated rows are documents of their own.
    """
    return mixing.mixed_rows(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the token counts and digests of every text; a null text has no tokens."""
    small_batches(spark)
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary(), kept=REMEMBERED)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the classifier, the components and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what goes from one to the next is checkpointed."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
