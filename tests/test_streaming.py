import json
import os

from gatherlens.sources.entities import typed_event
from gatherlens.streaming import occurrence as ST


def test_stream_counts_equal_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    events = [{"id": f"e{i}", "group": {"id": i % 3}, "time": 1704067200000 + i * 3600_000}
              for i in range(30)]
    for k in range(3):
        with open(os.path.join(src, f"part-{k}.json"), "w") as f:
            for e in events[k * 10:(k + 1) * 10]:
                f.write(json.dumps(e) + "\n")
    groups = spark.createDataFrame([(0, "A", "t1", "UTC"), (1, "A", "t2", "America/Denver"),
                                    (2, "B", "t1", "America/New_York")],
                                   "group_id long, city string, topic string, timezone string")
    out = os.path.join(tmpdir_path, "out")
    q = ST.start_occurrence(ST.event_stream(spark, src, max_files_per_trigger=1), groups, out,
                            os.path.join(tmpdir_path, "ckpt"), bucket="hour", available_now=True)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    batch = ST.occurrence_counts(typed_event(spark.read.schema(ST.SC.RAW_EVENT).json(src)), groups, "hour")
    assert got == sorted(tuple(r) for r in batch.collect())
    assert sum(r[-1] for r in got) == 30


def test_stream_restarts_from_its_checkpoint(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    groups = spark.createDataFrame([(0, "A", "t1", "UTC")],
                                   "group_id long, city string, topic string, timezone string")

    def add(name, start, n):
        with open(os.path.join(src, name), "w") as f:
            for i in range(start, start + n):
                f.write(json.dumps({"id": f"e{i}", "group": {"id": 0},
                                    "time": 1704067200000 + i * 86_400_000}) + "\n")

    out, ckpt = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt")
    add("a.json", 0, 7)
    ST.start_occurrence(ST.event_stream(spark, src), groups, out, ckpt, available_now=True) \
      .awaitTermination(120)
    assert sum(r.n for r in spark.read.parquet(out).collect()) == 7
    add("b.json", 7, 7)
    # a new query on the same checkpoint reads only the new file and keeps the state
    ST.start_occurrence(ST.event_stream(spark, src), groups, out, ckpt, available_now=True) \
      .awaitTermination(120)
    got = {r.weekday: r.n for r in spark.read.parquet(out).collect()}
    assert got == {d: 2 for d in range(7)}
