import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tesselink.llm import quality

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 8))
    n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_base_counts(spark):
    out = quality.judge(cases.frame(spark)).collect()
    text = {r[0]: r[1] for r in cases.rows()}
    assert len(out) == len(cases.rows())
    for r in out:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == brute(text[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"]) and r["size"] == "clash"


def test_js_distance(spark):
    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
        m = [(x + y) / 2 for x, y in zip(p, q)]
        return math.sqrt((kl(p, m) + kl(q, m)) / 2)

    rows = [([1, 2, 3], [3, 2, 1]), ([0, 5, 0], [4, 0, 1]), ([2, 2, 2], [1, 1, 1])]
    out = spark.createDataFrame(rows, "p array<long>, q array<long>").select("p", "q", quality.js_distance(F.col("p"), F.col("q")).alias("d")).collect()
    for r in out:
        assert abs(r["d"] - js(r["p"], r["q"])) < 1e-6
    none = spark.createDataFrame([([0, 0], [1, 1])], "p array<long>, q array<long>").select(quality.js_distance(F.col("p"), F.col("q"))).first()[0]
    assert none is None


def test_verdict_drops_symbols_and_keeps_prose(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in out if r["quality"] == 1]
    assert sum(good) / len(good) > 0.97
    odd = [(k, "The&&& onin### a$$$ heha*** th%%% nder%%% Is%%% thti&&& " * 1 + " ".join(f"w{k}x{i}###$$$&&&" for i in range(60)), "en", "s", 0, "", "") for k in range(3)]
    prose = [(100 + k, " ".join(f"the house of stone{i} and light{k}" for i in range(60)) + ".", "en", "s", 0, "", "") for k in range(60)]
    out = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(odd + prose, cases.SCHEMA)).collect()}
    assert not any(out[k] for k in range(3)) and all(out[100 + k] for k in range(60))


def test_empty(spark):
    assert quality.judge(cases.empty(spark)).count() == 0
