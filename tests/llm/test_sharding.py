import itertools
import random
import zlib

from pyspark.sql import functions as F

from tesselink.llm import sharding

from . import cases


def smallest_capacity(sizes, shards):
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    return next(c for c in itertools.count(max(sizes, default=0)) if fits(c))


def test_cuts_are_minimax(spark):
    rng = random.Random(1)
    for n, k in ((1, 3), (5, 2), (30, 4), (200, 7), (12, 12), (9, 20)):
        sizes = [rng.randint(1, 60) for _ in range(n)]
        p = [0, *itertools.accumulate(sizes)]
        cells = spark.createDataFrame([(p, max(sizes))], "p array<long>, most long")
        capacity, ends = sharding.minimax_cuts(cells, k)
        assert capacity == smallest_capacity(sizes, k)
        assert ends[-1] == n and len(ends) == k
        assert max(p[b] - p[a] for a, b in zip([0, *ends], ends)) <= capacity


def test_shard(spark):
    frame = cases.frame(spark)
    out = sharding.shard(frame, 8).collect()
    assert len(out) == len(cases.rows())
    text = {r[0]: r[1] or "" for r in cases.rows()}
    by_text = {}
    for r in out:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and r["kept"] == "clash"
        by_text.setdefault(t, set()).add(r["shard"])
        assert r["grown_shard"] is None and 0 <= r["shard"] < 8
    assert all(len(x) == 1 for x in by_text.values())
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_hot_group_is_dealt(spark):
    rows = [(k, "same" if k % 3 else f"t{k}", None, None, 0, "", "") for k in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, cases.SCHEMA), 5).collect()
    assert len({r["shard"] for r in out if r["doc_id"] % 3}) == 1
    for s in range(5):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_empty(spark):
    assert sharding.shard(cases.empty(spark), 4).count() == 0


def test_cuts_of_groups_are_minimax_however_coarse_the_first_ranges(spark):
    rng = random.Random(3)
    for n, k, bits in ((1, 3, 2), (40, 4, 2), (300, 7, 3), (3000, 40, 4), (3000, 5, 16)):
        sizes = {rng.getrandbits(64) - (1 << 63): rng.choice([17, 40, 90, 900]) for _ in range(n)}
        if n == 300:
            sizes[next(iter(sizes))] = 40_000  # one group beyond the mean
        groups = spark.createDataFrame(list(sizes.items()), "h long, bytes long")
        capacity, cuts = sharding.group_cuts(groups, k, bits)
        order = [sizes[h] for h in sorted(sizes)]
        assert capacity == smallest_capacity(order, k)
        filled = [0] * k
        for h, b in sizes.items():
            filled[sum(h > c for c in cuts[:-1])] += b
        assert max(filled) <= capacity and cuts[-1] == max(sizes)


def test_bytes_of_the_shards_are_as_even_as_equal_texts_allow(spark):
    rng = random.Random(4)
    rows = [(k, "x" * rng.randint(0, 900) if k % 3 else "the same", None, None, 0, "", "") for k in range(4000)]
    frame = spark.createDataFrame(rows, cases.SCHEMA)
    out = sharding.shard(frame, 6).collect()
    filled = [0] * 6
    for r in out:
        filled[r["shard"]] += r["size"]
    by = frame.select(F.xxhash64("text").alias("h"), (F.octet_length("text") + 16).alias("b")).groupBy("h").agg(F.sum("b").alias("b")).collect()
    assert max(filled) <= smallest_capacity([r["b"] for r in sorted(by, key=lambda r: r["h"])], 6)
