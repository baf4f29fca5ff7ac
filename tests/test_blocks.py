import math

import pytest
from pyspark.sql import functions as F

from tesselink.operators import blocks, windows
from tesselink.plans import fixtures as fx
from tesselink.plans import queries

P = "rec_id long, s1_id long, p double"


def _rows(df, columns):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in (r[c] for c in columns)) for r in df.collect()), key=str)


def _block(spark, records, entities, levels):
    """A block with many ties, entities out of order, in one partition."""
    rows = [(r * 3, e, float((r * 7 + e * 5) % levels) / levels) for r in range(records) for e in [(k * 7) % entities for k in range(entities)]]
    return spark.createDataFrame(rows, P).coalesce(1)


@pytest.mark.parametrize("records, entities, levels", [(40, 13, 4), (1, 5, 3), (9, 1, 5), (1, 1, 2), (25, 18, 1000)])
def test_context_of_blocks(spark, records, entities, levels):
    x = _block(spark, records, entities, levels)
    got = blocks.context(_lists(spark, x.collect()))
    assert _rows(got, got.columns) == _rows(windows.context(x), got.columns)


def _lists(spark, rows):
    by = {}
    for r, e, p in rows:
        by.setdefault(r, ([], []))[0].append(e)
        by[r][1].append(p)
    return spark.createDataFrame([(r, *x) for r, x in by.items()], "rec_id long, s1_ids array<long>, ps array<double>").coalesce(1)


def _refused(spark, rows):
    with pytest.raises(Exception, match="of a block must"):
        blocks.context(_lists(spark, rows)).collect()


def test_pairs_that_are_no_block_are_refused(spark):
    _refused(spark, [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.5)])
    _refused(spark, [(1, 1, 0.5), (1, 2, 0.5), (2, 2, 0.5), (2, 1, 0.5)])
    _refused(spark, [(2, 1, 0.5), (1, 1, 0.5)])
    _refused(spark, [(1, 1, 0.5), (1, 1, 0.5)])
    _refused(spark, [(1, 1, None)])


def _moved(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Window" in plan or "Exchange hashpartitioning(rec_id" in plan or "Exchange hashpartitioning(s1_id" in plan


def test_context_windows_moves_no_pair(spark, sf_dir):
    assert not _moved(queries.context_windows(spark, sf_dir))


def test_repeated_keys_go_by_windows(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "c_custkey long, c_nationkey int").withColumn("c_name", F.lit("a")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, 1 + k % 2) for k in range(4)], "s_suppkey long, s_nationkey int").withColumn("s_name", F.lit("b")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "N"), (2, "M")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert fx.block_lists(spark, str(tmp_path)) is None
    got = {(r["rec_id"], r["s1_id"]): r["c_rec_n"] for r in queries.context_windows(spark, str(tmp_path)).collect()}
    assert got == {(1, k): 4 for k in range(4)} | {(2, 0): 2, (2, 2): 2}


@pytest.mark.parametrize("records, entities, levels", [(40, 13, 4), (1, 5, 3), (9, 1, 5), (1, 1, 2), (25, 18, 1000)])
def test_group_features_of_blocks(spark, records, entities, levels):
    x = _block(spark, records, entities, levels)
    got = blocks.group_features(_lists(spark, x.collect()))
    assert _rows(got, got.columns) == _rows(windows.group_features(x), got.columns)


def test_best_competitor_moves_no_pair(spark, sf_dir):
    assert not _moved(queries.best_competitor(spark, sf_dir))


def test_few_lists_are_sent_at_once(spark):
    blocks.context(_lists(spark, [(1, 1, 0.5)]))
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= blocks.LISTS
