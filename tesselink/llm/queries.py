"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, licenses, mixing, oracles, quality, secrets, sharding, simhash, spotsigs
from .common import table

#: Weights of the sources, words of the mix and most words of a source, both as a multiple of what there is.
MIX = {"weights": (5, 2, 1), "share": 1.5, "cap": 2.0}
#: What both rows of the added conversation say.
SAID = "<|im_end|><|im_start|>assistant ok"
#: Tokens of a chat window.
BUDGET = 512
#: Places of the distances that a query shows.
DIGITS = 6


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file: in the folder that TESSELINK_TOKENIZERS names, else in the installed package."""
    folder = os.environ.get("TESSELINK_TOKENIZERS")
    return os.path.join(folder, name) if folder else str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, **MIX).select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], turns.schema)
    return chat.read_back(chat.format_windows(turns.unionByName(extra), budget=BUDGET))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = langid.train(known)
    return langid.identify(docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs).drop("lang").withColumns({c: F.round(c, DIGITS) for c in ("char_distance", "word_distance")})


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The base rules come first; then only their blobs' pairs with the other rules are unseen.
    ledger = secrets.advance(docs, rules=tuple(r for r in secrets.RULES if r.kind in secrets.BASE))
    found = secrets.scan(docs, ledger)
    kinds = [r.kind for r in secrets.RULES]
    base = [kinds.index(k) for k in secrets.BASE]
    of = lambda *ks: F.filter("spans", lambda s: s["kind"].isin(*ks))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{kinds[k]}") for k in base],
        F.sha2(secrets.written(of(*base)), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_sharding, op4_chat, op5_spotsigs, op6_language, op7_quality, op8_secrets, op9_bpe, op10_licenses)}
ORACLE = {"op1_mixing": oracles.mixing_sql(**MIX), "op4_chat": oracles.chat_sql(SAID, BUDGET), "op7_quality": oracles.quality_sql(DIGITS), "op8_secrets": oracles.secrets_sql(), "op10_licenses": oracles.licenses_sql()}
