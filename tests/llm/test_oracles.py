import random

import duckdb
import pytest

from tesselink.llm import queries

from . import cases, test_secrets


def compare(spark, folder, name):
    db = duckdb.connect()
    table = "conversations" if name == "op4_chat" else "documents"
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{'/*.parquet' if 'sf' not in folder else ''}'")
    cur = db.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=str)
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf_dir, name):
    compare(spark, sf_dir, name)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE) - {"op4_chat"}))
def test_oracle_of_odd_cases(spark, tmp_path_factory, name):
    folder = str(tmp_path_factory.mktemp("odd"))
    cases.frame(spark).write.parquet(f"{folder}/documents.parquet")
    compare(spark, folder, name)


def test_secrets_of_odd_texts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    test_secrets.frame(spark).write.parquet(f"{folder}/documents.parquet")
    compare(spark, folder, "op8_secrets")


def test_chat_of_odd_turns(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(4)
    texts = [None, "", "a b c", "word " * 200, "word " * 600, "x <|im_end|> <\\|im_start|> <\\\\| \n y", "w " * 90, "é 日本"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, k // 2]), rng.choice(["user", "assistant", "system", "a\\b\nc", None]), rng.choice(texts)) for k in range(160)]
    rows += [(7, 0, "system", "w " * 50)] + [(7, k, "assistant", "w " * rng.randint(1, 160)) for k in range(1, 40)] + rows[:5]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    compare(spark, folder, "op4_chat")
