import random
import re

from tesselink.llm import licenses

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    best = {}
    for label, template in licenses.TEMPLATES:
        t = set(WORD.findall(template.lower()))
        for at in range(0, max(1, len(w) - licenses.BLOCK // 2), licenses.BLOCK // 2):
            share = len(t & set(w[at : at + licenses.BLOCK])) / len(t)
            if share >= licenses.THRESHOLD - 1e-12:
                best[label] = max(share, best.get(label, 0))
    labels = {x for _, x in found}
    return (len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted(labels)), ",".join(sorted(labels | best.keys())), 1.0 if found else max(best.values(), default=0.0))


def texts():
    rng = random.Random(12)
    filler = lambda n: " ".join(rng.choice(["the", "of", "haus", "été", "to", "software", "license", "use"]) for _ in range(n))
    out = cases.texts() + ["MIT License", "cc by cc by-nc CC_BY", "xmit license", "apache license apache license", "gnu\n\ngeneral/public LICENSE", "日本 mit license"]
    for label, text in licenses.TEMPLATES:
        out += [text, filler(300) + " " + text + " " + filler(200), filler(97) + "\n" + text.upper()]
        for drop in (0.1, 0.19, 0.21, 0.4):
            out.append(filler(50) + " " + " ".join(w for w in text.split() if rng.random() > drop) + " " + filler(90))
    return out


def test_scan(spark):
    rows = [(k, t, None, None, 0, "clash", "") for k, t in enumerate(texts())]
    out = licenses.scan(spark.createDataFrame(rows + rows[:3], cases.SCHEMA)).collect()
    assert len(out) == len(rows) + 3
    for r in out:
        got = tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
        want = brute(texts()[r["doc_id"]])
        assert got[:6] == want[:6] and abs(got[6] - want[6]) < 1e-9, r["doc_id"]
    assert all(any(label in r["labels"].split(",") for r in out) for label, _ in licenses.TEMPLATES)


def test_empty(spark):
    assert licenses.scan(cases.empty(spark)).count() == 0


def test_filters_leave_pairs_out(monkeypatch):
    """Each filter decides on some pair, and none changes what is found."""
    words = [f"w{k}" for k in range(40)]
    templates = (("a", " ".join(words[:20])), ("b", " ".join(words[10:40])))
    index = licenses.Index.build({w.encode(): k for k, w in enumerate(words)}, templates)
    rank = lambda ws: sorted(index.rank[w.encode()] for w in ws)
    met = lambda t, ws: index.met(t, rank(ws), frozenset(rank(ws)))
    assert met(0, words[:16]) == 16 and met(0, words[:15]) == 0  # length
    assert met(0, words[5:40]) == 0  # the template's first five words are missing, and 15 can follow
    assert met(1, words[:9] + words[12:30]) == 0 and met(1, words[16:40]) == 24
    rng = random.Random(2)
    for _ in range(300):
        block = rng.sample(words, rng.randint(1, 40))
        for t, (_, text) in enumerate(templates):
            n = len(set(text.split()) & set(block))
            assert met(t, block) == (n if n >= index.need[t] else 0)


def test_templates_fit_into_half_a_block():
    assert all(len(licenses.words_of(text)) <= licenses.BLOCK // 2 for _, text in licenses.TEMPLATES)
