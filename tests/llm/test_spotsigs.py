import hashlib
import itertools
import random
import string

from pyspark.sql import functions as F

from tesselink.llm import spotsigs

from . import cases


def brute_spots(text):
    """Strings of the spots, for texts of ASCII white space."""
    out = set()
    for k, line in enumerate((text or "").lower().split("\n")):
        words = [w for w in line.replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        at = [0] + [i for i, w in enumerate(words) if w in spotsigs.ANCHORS and i > 0]
        for i, end in zip(at, at[1:] + [len(words)]):
            chain = words[i:end]
            if i == 0:
                if words:
                    out.add(("^", *words[:end][: spotsigs.CHAIN]))
            elif len(chain) > 1:
                out.add(tuple(chain[: spotsigs.CHAIN + 1]))
    return out


def test_spots(spark):
    texts = sorted({t for t in cases.texts() if t and not t.isspace()}) + ["the cat sat\nof the dog\n\nx", "a  b\tthe  big red fox jumps of of stone"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", spotsigs.spots(F.col("text")).alias("s")).collect()
    brute = {k: brute_spots(t) for k, t in enumerate(texts)}
    got = {r["k"]: set(r["s"]) for r in rows}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in brute.items()}
    for a, b in itertools.combinations(brute, 2):
        assert len(got[a] & got[b]) == len(brute[a] & brute[b])


def brute_whole(text):
    """Strings of the whole spots, for texts of ASCII white space and punctuation."""
    out = set()
    for line in (text or "").lower().split("\n"):
        words = ["^", *line.split()]
        spot = []
        for i, w in enumerate(words):
            if len(spot) == spotsigs.CHAIN + 1 or i > 1 and w.strip(string.punctuation) in spotsigs.ANCHORS:
                out.add(tuple(spot))
                spot = []
            spot.append(w)
        if len(words) > 1:
            out.add(tuple(spot))
    return out


def test_whole_spots_hold_every_word(spark):
    rng = random.Random(11)
    parts = ["THE!!", "(of)", "the,", "and", "stone", "river.", "xx", "|", "$$", "haus", "\n", " \t", "^"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (1, 3, 4, 5, 150)] + ["of of of", "the", " \n ", "", "a" * 300_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", spotsigs.spots(F.col("text"), whole=True).alias("s")).collect()
    brute = {k: brute_whole(t) for k, t in enumerate(texts)}
    got = {r["k"]: set(r["s"]) for r in rows}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in brute.items()}
    for a, b in itertools.combinations(brute, 2):
        assert len(got[a] & got[b]) == len(brute[a] & brute[b])


def test_edits_show_in_texts_without_common_words(spark):
    texts = [" ".join(f"{c}{i}" for i in range(150)) for c in "xy"] + [" ".join(f"{c}{i} THE!!" for i in range(150)) for c in "vw"]
    out = spotsigs.edited_neighbours(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(out) == 4
    for r in out:
        assert len(r["fingerprint"]) >= 8 * 38 and 0.3 < r["near_edited"] < 0.8


def test_edited_neighbours(spark):
    rows = cases.rows()
    out = spotsigs.edited_neighbours(cases.frame(spark)).collect()
    assert len(out) == len(rows)
    order = sorted({(r[0], r[1] or "") for r in rows}, reverse=True)
    prints, want = {}, {}
    for i, (d, t) in enumerate(order):
        n, then = len(t) // 3, order[(i + 1) % len(order)][1]
        edited = t[: len(t) - n] + then[:n]
        want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edited == t, then == t)
    for r in out:
        n, sha, same, alike = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert not same or (r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"])
        assert not alike or r["near_next"] == 1
        a, b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (r["fingerprint"], r["edited_fingerprint"]))
        assert abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
        prints.setdefault(dict(order)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())


def test_order_of_many_and_far_ids(spark):
    rng = random.Random(8)
    ids = rng.sample(range(-(10**15), 10**15), 700) + list(range(900))
    out = spotsigs.following(spark.createDataFrame([(i, 1, 5) for i in ids], "doc_id long, h long, n long")).collect()
    order = sorted(set(ids), reverse=True)
    assert {r["doc_id"]: r["next_id"] for r in out} == {d: order[(k + 1) % len(order)] for k, d in enumerate(order)}


def test_near_pairs(spark):
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(400), rng.randint(1, 40))) for _ in range(120)]
    for s in sets[:60]:
        t = set(s)
        for _ in range(rng.randint(0, 3)):
            t ^= {rng.randrange(400)}
        sets.append(sorted(t))
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "id long, spots array<int>")
    for threshold in (0.8, 0.5):
        got = {(r["a"], r["b"]): r["likeness"] for r in spotsigs.near_pairs(frame, threshold).collect()}
        first = {}
        for k, s in enumerate(sets):
            if s:
                first.setdefault(tuple(s), k)
        want = {}
        for (s, a), (t, b) in itertools.combinations(first.items(), 2):
            j = len({*s} & {*t}) / len({*s} | {*t})
            if j >= threshold:
                want[min(a, b), max(a, b)] = j
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_empty(spark):
    assert spotsigs.edited_neighbours(cases.empty(spark)).count() == 0
