import hashlib
import math
import random

from pyspark.sql import functions as F

from tesselink.llm import mixing

from . import cases

WS = set(" \t\n\x0b\x0c\r")


def n_words(text):
    n, inside = 0, False
    for c in text or "":
        n += not inside and c not in WS
        inside = c not in WS
    return n


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s] + 1e-9} if free else set()
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        free -= over
        left = share * sum(sizes.values()) - sum(out.values())


def check(rows, taken_of):
    sizes = {}
    for _, text, _, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + n_words(text)
    want = brute_targets(sizes)
    taken = {}
    for r in taken_of:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1


def test_mix(spark):
    out = mixing.mix(cases.frame(spark)).collect()
    assert len(out) == len(cases.rows())
    check(cases.rows(), out)
    again = mixing.mix(cases.frame(spark).repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["text"] or "", r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_many_rows(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 30))), None, "hot" if k % 3 else f"s{k % 11}", 0, "", "") for k in range(3000)]
    check(rows, mixing.mix(spark.createDataFrame(rows, cases.SCHEMA)).collect())


def test_quality_orders_documents(spark):
    rows = [(k, "a b c d", None, "s", 7, "", "") for k in range(2000)] + [(9999, "x " * 3000, None, "t", 6000, "", "")]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    out = mixing.mix(docs, weights=(1, 9), share=0.3, quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("source = 's'").collect()
    even, odd = (sum(r["taken"] for r in out if r["doc_id"] % 2 == k) for k in (0, 1))
    assert even > 2 * odd > 0


def test_emit(spark):
    mixed = mixing.mix(cases.frame(spark))
    columns = cases.frame(spark).columns
    out = mixing.emit_mixed(mixed, columns, length_col="n_chars").collect()
    assert sum(n_words(r["text"]) for r in out) == sum(r["taken"] for r in mixed.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    texts = [t for t in cases.texts() if t]
    assert all(any(t.startswith(r["text"]) for t in texts) for r in out)


def test_mixed_rows_are_those_of_the_mix(spark):
    docs = cases.frame(spark)
    columns = [c for c in docs.columns if c != "size"]
    plain = mixing.emit_mixed(mixing.mix(docs), columns, length_col="n_chars").collect()
    rows = mixing.mixed_rows(docs, length_col="n_chars")
    assert rows.columns == docs.columns
    out = rows.collect()
    assert all(r["size"] == "clash" for r in out)  # the input's own column of that name
    assert sorted((tuple(r[c] for c in columns) for r in out), key=str) == sorted(map(tuple, plain), key=str)


def test_empty(spark):
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_weights_of_any_size(spark):
    """Weights far below 1 spread the keys over many orders; the budget ends in the middle of the light documents."""
    rows = [(k, " ".join(["w"] * (1 + k % 7)), "en", "s", 0, "", "") for k in range(3000)]
    weight = {k: 1.0 if k % 2 else 0.002 for k in range(3000)}
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    out = {r["doc_id"]: r for r in mixing.mix(docs, weights=(1,), share=0.75, quality=F.when(F.col("doc_id") % 2 == 1, 1.0).otherwise(0.002)).collect()}
    u = {k: (int(hashlib.md5(f"{mixing.SEED}|{k}".encode()).hexdigest()[:13], 16) + 0.5) / float(1 << 52) for k in weight}
    left = round(0.75 * sum(1 + k % 7 for k in weight))
    for k in sorted(weight, key=lambda k: -math.log(u[k]) / weight[k]):
        assert out[k]["taken"] == min(left, 1 + k % 7)
        left -= out[k]["taken"]
    plan = mixing.mix_plan(docs, weights=(1,), share=0.75, quality=F.when(F.col("doc_id") % 2 == 1, 1.0).otherwise(0.002)).first()
    assert plan["hi"] - plan["lo"] < 1 and plan["lo"] > 20
