import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselink.llm import simhash
from tesselink.llm.components import components

from . import cases


def brute_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """id of the smallest row reachable, for (id, fingerprint) rows."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [least[find(i)] for i in range(len(prints))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB éÉ\t\n\x1c日"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == brute_print(text)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(cases.texts()[9].split() * 3)
    whole = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint_of(text) == whole


def test_near_duplicates(spark):
    out = simhash.near_duplicates(cases.frame(spark)).collect()
    rows = [(r[0], brute_print(r[1])) for r in cases.rows()]
    want = sorted(zip((d for d, _ in rows), (f"{p:016x}" for _, p in rows), brute_components(rows)))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == want
    assert "size" in out[0]


def near(rng, centre, most):
    for b in rng.sample(range(64), rng.randint(1, most)):
        centre ^= 1 << b
    return centre


def grouped(prints, of):
    groups = {}
    for x, root in zip(prints, of):
        groups.setdefault(root, set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_links_are_whole_also_in_crowded_cells(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(100)}
    for centre in list(prints)[:4]:
        prints |= {near(rng, centre, 5) for _ in range(120)}
    centre = rng.getrandbits(64)
    prints |= {centre ^ rng.getrandbits(11) for _ in range(2000)}  # thousands in one cell: all but the lowest block is alike
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    assert grouped(prints, [found.get(simhash._signed(x), simhash._signed(x)) for x in prints]) == grouped(prints, brute_components(list(zip(prints, prints))))


def test_every_link_is_found(spark):
    rng = random.Random(10)
    prints = {rng.getrandbits(64) for _ in range(30)}
    prints = sorted(prints | {near(rng, x, 3) for x in prints for _ in range(8)})
    frame = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    assert {frozenset((r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1)) for r in simhash.links(frame).collect()} == want


def test_null_ids_and_clashing_names(spark):
    t = " ".join(f"w{k}" for k in range(40))
    rows = [(1, t, "x", 1, 2, "f"), (None, t, "y", 3, 4, "g"), (2, t, "z", 5, 6, "h"), (None, "other", "u", 7, 8, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __of string, __fp long, fp long, Fingerprint string")
    out = simhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "__of", "__fp", "fp", "fingerprint", "component_id"]
    got = sorted(((r["__of"], r["__fp"], r["fp"], r["fingerprint"], r["component_id"]) for r in out.collect()), key=str)
    assert got == [(o, a, b, f"{brute_print(x):016x}", None if x == "other" else 1) for _, x, o, a, b, _ in sorted(rows, key=lambda r: r[2])]
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(tuple(r) for r in left.collect() if r["doc_id"]) == [rows[0]]
    assert [tuple(r) for r in left.collect() if not r["doc_id"]] == [rows[3]]


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)}


def test_one_of_each_group_stays(spark):
    out = simhash.drop_near_duplicates(cases.frame(spark)).collect()
    rows = [(r[0], brute_print(r[1])) for r in cases.rows()]
    assert sorted(r["doc_id"] for r in out) == sorted(set(brute_components(rows)))
    distinct = cases.frame(spark).dropDuplicates(["doc_id"])
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(distinct).collect()) == sorted(set(brute_components(rows)))


def test_one_of_each_group_stays_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    copied = [(3, a), (7, a), (7, b), (None, a), (None, c), (None, c)]
    plain = [(1, a), (2, b), (None, a), (None, b), (9, a)]
    lone = [(1, a), (None, b), (5, a)]
    for rows in (copied, plain, lone):
        out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        want = {}
        for doc, text in rows:
            want[text] = min(want.get(text, doc), doc, key=lambda x: (x is None, x or 0))
        assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(((d, t) for t, d in want.items()), key=str)


def test_empty(spark):
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(cases.empty(spark)).count() == 0


def test_cells_are_never_broadcast(spark):
    prints = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    assert "rightHint=(strategy=merge)" in simhash.links(prints)._jdf.queryExecution().optimizedPlan().toString()
