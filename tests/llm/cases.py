"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, names that clash."""

import random

import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"


def texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "house", "river", "stone", "light", "green", "walks", "over", "der", "die", "haus", "licht", "token", "été", "日本"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = line(60)
    out = [None, "", "   \n\t ", "one", "two words", "a b c", "a b c", "!!! ### $$$", "12345 67890", line(3000), "x" * 20000, base, base, base + " end",
           "\n".join([line(9)] * 6), "tab\tsep\x0bvt\x0cff\rcr\x1cfs\x85nel nbsp", "Ünï çödé ẞ İ ſ K", "\U0001f600 emoji \U0001f600", "<|endoftext|> <|im_end|>"]
    out += [line(rng.randint(5, 120)) for _ in range(40)]
    return out


def rows():
    rng = random.Random(6)
    out = []
    for k, t in enumerate(texts()):
        lang = rng.choice(["en", "de", None])
        source = [None, "s1", "s2", "é", "s1", "s1"][k % 6]
        out.append((k * 7 % 61 + (k // 61) * 61, t, lang, source, None if t is None else len(t), "clash", "clash"))
    out.append(out[11])  # a repeated row
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pandas():
    return pd.DataFrame(rows(), columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(object)
