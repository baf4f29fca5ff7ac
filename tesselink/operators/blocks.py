"""Ranks, sums and competitors by record and by entity of blocks whose records meet all of its entities.

Both orders of such pairs are worked out in the task that makes them, so that no pair is moved: a block's scores are kept
as numbers into the table of its different scores, two bytes for each pair up to 2**16 of these.  Ties in a rank go by the
other side's id, as in ``windows``, whose functions do the same for pairs of any kind by moving them.

``lists``: (rec_id, s1_ids, ps) without nulls, a row for each record with its entities and their scores; a partition holds one
block or none, its records in the order of their ids, all with the same entities (``fixtures.block_lists``).  Others are refused.
Lists reach Python many times faster than as many rows of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Rows of a batch that is given back, about.
ROWS = 1 << 16
#: Lists that Spark sends to Python at once; the setting stays in the session, as it is read when a query runs.
LISTS = 256
#: Entities whose records are ranked at once.
TILE = 16


def half_up(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded, halves away from zero."""
    if digits is None:
        return x
    m = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * m + 0.5) / m, x) + 0.0


class Block:
    """The scores of a block: ``codes``, rows of records by columns of entities, 0 for its best score (``scores``)."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.codes: list[np.ndarray] = []
        records, known, entities = [], {}, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rec, met, scores = batch.columns
            s1, p = met.flatten(), scores.flatten()
            if any(x.null_count for x in (rec, met, scores, s1, p)):
                raise ValueError("pairs of a block must not have nulls")
            records.append(rec.to_numpy(zero_copy_only=False))
            s1 = s1.to_numpy(zero_copy_only=False)
            if entities is None:
                entities = s1[: met.offsets[1].as_py() - met.offsets[0].as_py()].copy()
            shape = len(rec), len(entities)
            even = lambda x: (np.diff(x.offsets.to_numpy()) == shape[1]).all()
            if not (even(met) and even(scores) and (s1.reshape(shape) == entities).all()):
                raise ValueError("records of a block must meet the same entities in the same order")
            found = pc.dictionary_encode(p)
            values = found.dictionary.to_numpy(zero_copy_only=False)
            if np.isnan(values).any():
                raise ValueError("scores of a block must be numbers")
            codes = np.array([known.setdefault(v, len(known)) for v in values.tolist()], "uint32")[found.indices.to_numpy()]
            self.codes.append(codes.astype("uint16" if len(known) <= 1 << 16 else "uint32").reshape(shape))
        self.records = np.concatenate(records) if records else np.empty(0)
        if not records:
            return
        if not (self.records[1:] > self.records[:-1]).all():
            raise ValueError("records of a block must stand once, in the order of their ids")
        by_id = np.argsort(entities, kind="stable")
        self.entities = entities[by_id]
        if (self.entities[1:] == self.entities[:-1]).any():
            raise ValueError("a record of a block must meet an entity once")
        scores = np.fromiter(known, float, len(known))
        best_first = np.argsort(-scores, kind="stable")
        self.scores = scores[best_first]
        place = np.empty(len(scores), "uint16" if len(scores) <= 1 << 16 else "uint32")
        place[best_first] = np.arange(len(scores))
        for k, codes in enumerate(self.codes):
            self.codes[k] = place[codes[:, by_id]]

    def rank_by_entity(self) -> None:
        """``ranks`` (rows as ``codes``) and, by entity, ``counts`` sums, and the places of the two best records."""
        n, m = len(self.records), len(self.entities)
        self.ranks = [np.empty(c.shape, "uint16" if n < 1 << 16 else "uint32") for c in self.codes]
        places = np.arange(1, n + 1, dtype=self.ranks[0].dtype)[None]
        self.sums, self.above = np.empty(m), np.empty(m, "int64")
        self.first, self.second = np.empty(m, "int64"), np.full(m, -1)
        self.best, self.next = np.empty(m), np.zeros(m)
        for a in range(0, m, TILE):
            b = min(a + TILE, m)
            tile = np.ascontiguousarray(np.concatenate([c[:, a:b] for c in self.codes]).T)
            order = np.argsort(tile, axis=1, kind="stable")
            rank = np.empty(tile.shape, places.dtype)
            np.put_along_axis(rank, order, places, axis=1)
            rank, at = rank.T, 0
            for r in self.ranks:
                r[:, a:b] = rank[at : at + len(r)]
                at += len(r)
            p = self.scores[tile]
            self.sums[a:b], self.above[a:b] = p.sum(axis=1), (p > 0.5).sum(axis=1)
            own = np.arange(b - a)
            self.first[a:b], self.best[a:b] = order[:, 0], p[own, order[:, 0]]
            if n > 1:
                self.second[a:b], self.next[a:b] = order[:, 1], p[own, order[:, 1]]

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some records at a time: their ids, codes, ranks by entity, ranks by record, and codes from the best one."""
        at, step = 0, max(1, ROWS // len(self.entities))
        places = np.arange(1, len(self.entities) + 1)[None]
        for codes, ranks in zip(self.codes, self.ranks):
            for k in range(0, len(codes), step):
                c, r = codes[k : k + step], ranks[k : k + step]
                order = np.argsort(c, axis=1, kind="stable")
                own = np.empty(c.shape, "int64")
                np.put_along_axis(own, order, places, axis=1)
                yield self.records[at : at + len(c)], c, r, own, np.take_along_axis(c, order[:, :2], axis=1)
                at += len(c)


def _context(block: Block, digits: int | None) -> Iterator[dict[str, np.ndarray]]:
    sums = half_up(block.sums, digits)
    for _, codes, by_entity, by_record, best in block.parts():
        yield {
            "c_rec_n": np.full(codes.shape, len(block.entities)), "c_s1_n": np.full(codes.shape, len(block.records)), "c_rec_rank": by_record,
            "c_rec_gap": half_up(block.scores[best[:, :1]] - block.scores[codes], digits), "c_s1_rank": by_entity, "c_s1_psum": np.broadcast_to(sums, codes.shape)}


def _group_features(block: Block, digits: int | None) -> Iterator[dict[str, np.ndarray]]:
    wide = lambda x, shape: np.broadcast_to(x, shape)
    sums, top, scores = half_up(block.sums, digits), half_up(block.best, digits), block.scores
    one, two = half_up(block.best, digits), half_up(block.next, digits)
    first, second = block.records[block.first], block.records[block.second]
    lone = len(block.records) == 1
    for _, codes, by_entity, by_record, best in block.parts():
        p, shape = scores[codes], codes.shape
        most = scores[best[:, :1]]
        other = np.where(by_record == 1, scores[best[:, 1:2]] if best.shape[1] > 1 else 0.0, most)
        leads = by_entity == 1
        yield {
            "g_rec_max": wide(half_up(most, digits), shape), "g_rec_rank": by_record, "g_rec_sum": wide(half_up(p.sum(axis=1, keepdims=True), digits), shape), "g_s1_rank": by_entity,
            "g_s1_sum": wide(sums, shape), "g_s1_n50": wide(block.above, shape), "g_s1_max": wide(top, shape), "g_rec_other": half_up(other, digits), "g_rec_margin": half_up(p - other, digits),
            "g_sib_p": np.where(leads, two, one), "sib_id": None if lone else np.where(leads, second, first)}


def _worker(rows: Callable[[Block, int | None], Iterator[dict]], schema: pa.Schema, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(batches)
        if not len(block.records):
            return
        block.rank_by_entity()
        n, at = len(block.entities), 0
        for columns in rows(block, digits):
            shape = next(x.shape for x in columns.values() if x is not None)
            own = {"rec_id": np.repeat(block.records[at : at + shape[0]], n), "s1_id": np.tile(block.entities, shape[0])} | columns
            at += shape[0]
            flat = lambda x, kind: pa.nulls(shape[0] * n, kind) if x is None else pa.array(x.reshape(-1).astype(kind.to_pandas_dtype(), copy=False), kind) if pa.types.is_primitive(kind) else pa.array(x.reshape(-1), kind)
            yield pa.RecordBatch.from_arrays([flat(own[f.name], f.type) for f in schema], schema=schema)

    return run


def _mapped(lists: DataFrame, rows, names: dict[str, str], digits: int | None) -> DataFrame:
    kinds = dict(lists.select("rec_id", F.explode("s1_ids").alias("s1_id")).dtypes)
    schema = StructType([StructField(k, _parse_datatype_string(kinds.get(v, v))) for k, v in {"rec_id": "rec_id", "s1_id": "s1_id", **names}.items()])
    conf, key = lists.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= LISTS:
        conf.set(key, str(LISTS))
    return lists.select("rec_id", "s1_ids", "ps").mapInArrow(_worker(rows, to_arrow_schema(schema), digits), schema)


def context(lists: DataFrame, digits: int | None = None) -> DataFrame:
    """(rec_id, s1_id) with the columns of ``windows.context``, doubles rounded to ``digits``."""
    names = {"c_rec_n": "long", "c_s1_n": "long", "c_rec_rank": "long", "c_rec_gap": "double", "c_s1_rank": "long", "c_s1_psum": "double"}
    return _mapped(lists, _context, names, digits)


def group_features(lists: DataFrame, digits: int | None = None) -> DataFrame:
    """(rec_id, s1_id) with the columns of ``windows.group_features``, doubles rounded to ``digits``."""
    names = {"g_rec_max": "double", "g_rec_rank": "long", "g_rec_sum": "double", "g_s1_rank": "long", "g_s1_sum": "double", "g_s1_n50": "long", "g_s1_max": "double",
             "g_rec_other": "double", "g_rec_margin": "double", "g_sib_p": "double", "sib_id": "rec_id"}
    return _mapped(lists, _group_features, names, digits)
