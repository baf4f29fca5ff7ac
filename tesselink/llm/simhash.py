"""SimHash near-duplicates through a table of distances to reference fingerprints (pivots).

A fingerprint has a bit for each position in which over half of the shingles' hashes have it.  Two
fingerprints within ``RADIUS`` = 2 bits are found without comparing all pairs:

* The table holds each distinct fingerprint's Hamming distances to 96 references.  The references come in
  pairs p and p ^ mask, one mask for each of six blocks of the 64 bits; the difference of a pair's two
  distances depends on the bits of that block alone.  Two differing bits leave four of the six blocks alike,
  so that two linked fingerprints agree in all differences of some four blocks: each of the 15 choices of
  four blocks names a cell of 42 to 44 bits.
* Of the pairs that meet in a cell, those whose distances to any of 16 references differ by more than 2 are
  discarded (triangle inequality), and the Hamming distance of the others is verified.

There is one way for cells of any size.  Only different fingerprints meet, copies count once, and those of one cell
differ in two blocks alone, so that the pairs follow the links that there are.

Nodes of the links are (id is null, least id, fingerprint), whose order makes the root of a component the row that
stands for it.

Defined cases: null or blank text has fingerprint 0, which links like any other; fewer than three words make
one shingle; texts of any length are read in blocks; repeated rows stay and share a component; further columns
pass through, whatever their names, but fingerprint and component_id are replaced; an empty table gives an empty
result; null ids are ignored as component ids unless the whole component has no other.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, others, packed, unpacked
from .components import components

WIDTH, SEED, RADIUS = 3, 42, 2
_BLOCKS = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))
#: Blocks that two linked fingerprints have alike.
_ALIKE = len(_BLOCKS) - RADIUS
_PAIRS = 8
#: References whose distances decide whether a pair is discarded: eight to a packed long.
_DECIDING = 16
#: At most so many rows (an id and a hash) to drop are broadcast, else they are joined by shuffle.
BROADCAST_ROWS = 200_000
_STEP = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _references() -> list[tuple[int, int, int]]:
    """(block, reference, its partner) for all pairs, from a fixed seed."""
    rng = random.Random(20_240_521)
    out = []
    for k, (lo, hi) in enumerate(_BLOCKS):
        mask = (1 << hi) - (1 << lo)
        for _ in range(_PAIRS):
            p = rng.getrandbits(64)
            out.append((k, _signed(p), _signed(p ^ mask)))
    return out


REFERENCES = _references()


def fingerprint_of(text: str | None, width: int = WIDTH) -> int:
    """The unsigned fingerprint of a text."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    n = max(1, len(tokens) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = tokens[at : min(at + _STEP, n) + width - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(width)))] if len(tokens) >= width else [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([_signed(fingerprint_of(x)) for x in text], dtype="int64")


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long."""
    return F.pandas_udf(_fingerprints, T.LongType())(text)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _distance(x, y) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


_POINTS = np.array([[p & (1 << 64) - 1, q & (1 << 64) - 1] for _, p, q in REFERENCES], np.uint64).reshape(-1)
_CHOICES = list(itertools.combinations(range(len(_BLOCKS)), _ALIKE))


def _pivots(prints: pd.Series) -> pd.DataFrame:
    """Rows of the table of distances for a batch of fingerprints."""
    far = np.bitwise_count(prints.to_numpy(np.int64).view(np.uint64)[:, None] ^ _POINTS)
    apart = (far[:, 0::2].astype(np.int64) - far[:, 1::2] + np.array([_BLOCKS[k][1] - _BLOCKS[k][0] for k, _, _ in REFERENCES])) >> 1  # 0..11
    blocks = [(apart[:, k * _PAIRS : (k + 1) * _PAIRS] << 4 * np.arange(_PAIRS)).sum(1).astype(np.uint64) for k in range(len(_BLOCKS))]
    cells = []
    for n, own in enumerate(_CHOICES):
        cell = np.full(len(prints), n + 1, np.uint64)
        for k in own:  # a mixture of 64 bits; should two cells share one, their pairs are still verified
            cell = (cell ^ blocks[k]) * np.uint64(0x9E3779B97F4A7C15)
            cell ^= cell >> np.uint64(29)
        cells.append(cell)
    packed_far = np.ascontiguousarray(far[:, :: far.shape[1] // _DECIDING][:, :_DECIDING]).view(np.int64)
    return pd.DataFrame({"f0": packed_far[:, 0], "f1": packed_far[:, 1], "cells": list(np.stack(cells, 1).view(np.int64))})


def pivot_table(prints: DataFrame) -> DataFrame:
    """``prints`` (column fp) with f0 and f1, its packed distances to the deciding references, and ``cells``."""
    table = F.pandas_udf(_pivots, "f0 long, f1 long, cells array<long>")
    return prints.withColumn("table", table("fp")).select(*prints.columns, "table.f0", "table.f1", "table.cells")


def _within(x: Column, y: Column) -> Column:
    """Whether no packed distance of two long columns differs by more than the radius."""
    byte = lambda v, k: F.call_function("shiftright", v, 8 * k).bitwiseAND(F.lit(0xFF))
    return F.forall(F.sequence(F.lit(0), F.lit(7)), lambda k: F.abs(byte(x, k) - byte(y, k)) <= RADIUS)


def links(prints: DataFrame) -> DataFrame:
    """Pairs a < b of the distinct fingerprints (column fp) within 2 bits of each other; with a column ``node``, pairs of nodes."""
    named = prints if "node" in prints.columns else prints.withColumn("node", F.col("fp"))
    own = pivot_table(named).select("fp", "node", "f0", "f1", F.explode("cells").alias("cell"))
    other = own.select("cell", *[F.col(c).alias(c + "_2") for c in ("fp", "node", "f0", "f1")])
    met = own.join(other.hint("merge"), "cell").where("fp < fp_2")  # small when compressed, millions of rows: never to be broadcast
    near = met.where(_within(F.col("f0"), F.col("f0_2")) & _within(F.col("f1"), F.col("f1_2"))).where(_distance(F.col("fp"), F.col("fp_2")) <= RADIUS)
    return near.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()


def _prints(rows: DataFrame) -> DataFrame:
    """(fp, node) of the distinct fingerprints of ``rows`` (id, fp)."""
    return rows.groupBy("fp").agg(F.min("id").alias("id")).select("fp", F.struct(F.col("id").isNull().alias("none"), "id", "fp").alias("node"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    own = others(docs, text_col, "fingerprint", "component_id")
    rows = durable(docs.select(packed(own).alias("own"), F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")))
    prints = _prints(rows)
    roots = components(links(prints)).select(F.col("node.fp").alias("of"), F.col("root.id").alias("root_id"))
    joined = prints.join(roots.hint("merge"), F.col("fp") == F.col("of"), "left")
    named = durable(joined.select(F.col("fp").alias("of"), F.when(F.col("of").isNull(), F.col("node.id")).otherwise(F.col("root_id")).alias("component_id")))
    found = rows.join(named.hint("merge"), F.col("fp") == F.col("of"))
    return found.select(*unpacked("own", own), hexed(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each component stays: that of the smallest id (null last), then of the smallest fingerprint.

    A row is known by its id and a hash of its text; of rows alike in both any one stays.
    """
    text_hash = F.xxhash64(F.col(text_col))
    rows = durable(docs.select(F.col(id_col).alias("id"), text_hash.alias("h"), fingerprint(F.col(text_col)).alias("fp")))
    known = rows.groupBy("id", "h", "fp").agg(F.count("*").alias("n"))  # texts of one fingerprint may differ, so a row has a hash too
    first = known.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first"))
    prints = first.select("fp", F.struct(F.col("first.none").alias("none"), F.col("first.id").alias("id"), "fp").alias("node"))
    roots = components(links(prints))
    lesser = roots.where(F.col("node") != F.col("root")).select(F.col("node.fp").alias("of"))
    chosen = first.join(lesser, F.col("fp") == F.col("of"), "left_anti").select(F.col("first.id").alias("one"), F.col("first.h").alias("one_h"), F.col("fp").alias("one_fp"))
    one = F.col("id").eqNullSafe(F.col("one")) & (F.col("h") == F.col("one_h")) & (F.col("fp") == F.col("one_fp"))
    marked = durable(known.join(chosen, one, "left").select("id", "h", "n", F.col("one_h").isNotNull().alias("kept")))
    out = marked.agg(F.sum((~F.col("kept")).cast("long")).alias("gone"), F.max(F.col("kept") & (F.col("n") > 1)).alias("again")).first()
    row = packed(docs.columns)
    keyed = docs.select(row.alias("row"), F.col(id_col).alias("row_id"), text_hash.alias("row_h"))
    of = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_h") == F.col("h"))
    gone = marked.where(~F.col("kept")).select("id", "h")
    left = keyed.join(F.broadcast(gone) if (out["gone"] or 0) <= BROADCAST_ROWS else gone, of, "left_anti")
    if out["again"]:  # some chosen rows are there more than once
        more = marked.where(F.col("kept") & (F.col("n") > 1)).select("id", "h")
        left = left.join(more, of, "left_anti").unionByName(left.join(more, of, "left_semi").dropDuplicates(["row_id", "row_h"]))
    return left.select(*unpacked("row", docs.columns))
