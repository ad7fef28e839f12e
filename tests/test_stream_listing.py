"""A stream lists many files in few tasks."""

from __future__ import annotations

from passagemill.plans.ingest import IngestOptions
from passagemill.streaming.incremental import LISTED_BY_A_CORE, current_chunks, incremental_ingest


def test_many_files_in_few_tasks(spark, tmp_path):
    root, n = tmp_path / "docs", 150
    root.mkdir()
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    for i in range(n):
        (root / f"{i}.txt").write_text(f"text number {i}")
    tracker, out = spark.sparkContext.statusTracker(), str(tmp_path / "store")
    for more in (0, 40):
        for i in range(n, n + more):
            (root / f"{i}.txt").write_text(f"text number {i}")
        query = incremental_ingest(spark, str(root), out, str(tmp_path / "state"), IngestOptions(strategy="token"))
        query.awaitTermination()
        stages = [s for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
        tasks = [info.numTasks for s in stages if (info := tracker.getStageInfo(s))]
        assert tasks and max(tasks) <= LISTED_BY_A_CORE * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before
    assert sorted(r["text"] for r in current_chunks(spark, out).collect()) == sorted(f"text number {i}" for i in range(n + 40))
