"""Tables above the broadcast limit are not sent to every task, however small their files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm import minhash
from passagemill.llm.common import beside, broadcast_if_small, lookup, salted, with_row_id
from passagemill.session import materialize

ROWS = 150_000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    table = materialize(spark.range(ROWS).select((F.col("id") * 3).alias("node"), F.col("id").alias("label")), "labels")
    big = materialize(spark.range(4 * ROWS).select(F.col("id").alias("node"), F.xxhash64("id").alias("b")), "pairs")
    return big, table


@pytest.mark.parametrize("salts", [1, 16])
@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_large_tables_are_shuffled(tables, how, salts):
    big, table = tables
    limit = minhash.MinHashOptions().broadcast_nodes
    joins = [
        salted(big, table, ["node"], how, salts),
        beside(big, table, ["node"], how, limit, salts),
        lookup(big, table, ["node"], how, limit, salts),
        big.join(broadcast_if_small(table, limit, "table")[0], ["node"], how),
    ]
    assert [j for j in joins if "Broadcast" in _plan(j)] == []
    wanted = big.join(table, ["node"], how)
    for j in joins:
        assert j.columns == wanted.columns and j.count() == wanted.count()


def test_small_tables_are_broadcast(tables):
    big, table = tables
    assert "BroadcastHashJoin" in _plan(beside(big, materialize(table.limit(1000), "few"), ["node"], "left", 1000))


def test_groups_without_broadcasts(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    base = [[words[j] for j in rng.integers(0, 300, 60)] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1] + [f"end{i}"]) for i in range(4) for b in base] + [None, ""]
    docs = materialize(with_row_id(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")), "docs")
    few, all_of = (sorted(map(tuple, minhash.groups(docs, o).collect())) for o in (minhash.MinHashOptions(broadcast_nodes=1), None))
    assert few == all_of and len({r[3] for r in few}) < 30
