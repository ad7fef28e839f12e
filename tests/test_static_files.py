"""A token-vector table too large to broadcast is read by the tasks; nothing is shuffled for it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from passagemill.operators import embedding as emb
from passagemill.session import materialize


def test_large_token_table_moves_no_text(spark, monkeypatch):
    monkeypatch.setattr(emb, "HELD_TERM_BYTES", 500)
    monkeypatch.setattr(emb, "READ_TOKENS", 7)
    tokens = [(f"t{i}", 1.0 / (i + 1), [float(i % 3), float(i % 5), 1.0]) for i in range(40)]
    table = materialize(spark.createDataFrame(tokens, "token string, weight double, vector array<double>"), "tokens")
    texts = [(i % 50, " ".join(f"T{(i * j) % 45}" for j in range(1, 12)), i) for i in range(300)]
    # Ids that are null or come twice, texts that are null or hold no known token.
    texts += [(None, "t1 t2", 300), (None, "t3", 301), (7, None, 302), (8, "unknown only", 303), (9, "", 304)]
    df = materialize(spark.createDataFrame(texts, "id int, text string, row int"), "texts").repartition(3)
    many = emb.embed_static(df, "id", "text", table, broadcast_bytes=0)
    few = emb.embed_static(df, "id", "text", table)
    assert many.columns == few.columns and many.dtypes == few.dtypes
    a, b = ({r["row"]: r for r in x.collect()} for x in (many, few))
    assert len(a) == len(texts) and a.keys() == b.keys()
    assert all(a[k]["id"] == b[k]["id"] and a[k]["text"] == b[k]["text"] and np.allclose(a[k]["vector"], b[k]["vector"]) for k in a)
    written = emb.embed_static(materialize(df, "texts"), "id", "text", table, broadcast_bytes=0)
    assert "Exchange" not in written._jdf.queryExecution().executedPlan().toString()
    assert written.filter(F.col("vector").isNull()).count() == 0
