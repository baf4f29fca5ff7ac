"""Columns whose names an operator uses itself pass through, null ids are taken, and empty tables give empty results."""

import pytest
from pyspark.sql import functions as F

from tesselink.llm import bpe, langid, licenses, mixing, quality, queries, secrets, sharding, simhash

from . import cases

INNER = ["__of", "__fp", "fp", "node", "found_blob", "__blob", "__spans", "__text", "path", "due", "row", "own", "id", "cell", "at", "offset", "part", "parts", "rank", "__cell", "__part",
         "__offset", "__lang", "__words", "__counts", "__own", "__h", "__mix_key", "__mix_size", "__mix_own", "__mix_words", "key", "cut", "before", "__found", "h", "n", "kept_", "first"]

OPERATORS = {
    "mix": mixing.mix,
    "mixed_rows": lambda d: mixing.mixed_rows(d, length_col="n_chars"),
    "near_duplicates": simhash.near_duplicates,
    "drop_near_duplicates": simhash.drop_near_duplicates,
    "shard": lambda d: sharding.shard(d, 4),
    "identify": lambda d: langid.identify(d, langid.train(d)),
    "judge": quality.judge,
    "scan": secrets.scan,
    "redact": secrets.redact,
    "round_trip": lambda d: bpe.round_trip(d, queries.vocabulary()),
    "licenses": licenses.scan,
}


def rows():
    """A row for each text, some ids null; ``tag`` tells which row it is."""
    own = cases.rows()
    return [(None if k % 5 == 0 else r[0], *r[1:5], k, *[f"{c}{k}" for c in INNER]) for k, r in enumerate(own)]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_names_and_null_ids(spark, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long, tag int, " + ", ".join(f"`{c}` string" for c in INNER)
    docs = spark.createDataFrame(rows(), schema)
    out = OPERATORS[name](docs)
    assert set(INNER) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    if name not in ("mixed_rows", "drop_near_duplicates"):
        assert sorted(r["tag"] for r in got) == list(range(len(rows())))
    assert got and all(r[c] == f"{c}{r['tag']}" for r in got for c in INNER)
    assert {r["doc_id"] for r in got} >= {None}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_case(spark, name):
    """A column that differs from an added one by case alone is replaced, not doubled."""
    docs = cases.frame(spark).drop("size", "kept").select("*", *[F.lit("x").alias(c) for c in ("Fingerprint", "SIZE", "Spans", "Kept", "Lang_Pred", "Labels")])
    out = OPERATORS[name](docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty(spark, name):
    assert OPERATORS[name](cases.empty(spark)).count() == 0
