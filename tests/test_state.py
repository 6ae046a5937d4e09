"""State of streams over restarts, upserts by bucket, and postings kept at write."""

import os
import random
import shutil

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import kept, postings, upserts
from sparkloom.plans.catalog import QUERIES
from sparkloom.streaming import jobs, state

FOLDER = "/root/testdata/sf0.001"


def parts(tmp_path, n):
    """The events in n files that follow each other in time."""
    events = pq.read_table(f"{FOLDER}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    os.makedirs(tmp_path / "parts")
    cut = [events.num_rows * i // n for i in range(n + 1)]
    for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        pq.write_table(events.slice(a, b - a), tmp_path / f"parts/{i}.parquet")
        os.utime(tmp_path / f"parts/{i}.parquet", (1_700_000_000 + 60 * i,) * 2)


@pytest.mark.parametrize("name,made", [("win_05", state.timeouts), ("win_06", state.streaks)])
def test_state_goes_on_after_a_restart(spark, tmp_path, name, made):
    parts(tmp_path, 4)
    os.makedirs(tmp_path / "in/events.parquet")
    for some in ((0, 1), (2, 3)):
        for i in some:
            shutil.copy2(tmp_path / f"parts/{i}.parquet", tmp_path / "in/events.parquet")
        got = made(jobs.table_stream(spark, str(tmp_path / "in"), "events", files_per_trigger=1), path=str(tmp_path / "out"))
    want = QUERIES[name](spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert spark.conf.get(state.PROVIDER) != state.ROCKSDB


def test_job_status(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(1, 5), i, rng.choice([*state.STATUSES, "odd", None]), rng.choice([None, float(rng.randint(0, 9))])) for i in range(120)]
    for n, at in enumerate(range(0, 120, 40)):
        spark.createDataFrame(rows[at : at + 40], "job_id long, event_id long, status string, chunks double").withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("job_id long, event_id long, status string, chunks double, ts timestamp").parquet(str(tmp_path / "in"))
        got = state.job_status(stream, ("chunks",), path=str(tmp_path / "out"))
        seen = rows[: 40 * (n + 1)]
        want = []
        for job in sorted({r[0] for r in seen}):
            told = [r[2] for r in seen if r[0] == job and r[2] in state.STATUSES]
            given = [r[3] for r in seen if r[0] == job and r[3] is not None]
            want.append((job, told[-1] if told else None, sum(state.STATUSES[b] < state.STATUSES[a] for a, b in zip(told, told[1:], strict=False)), given[-1] if given else None))
        assert sorted(map(tuple, got.collect())) == want


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_upsert_touches_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = {f"k{i}": (f"k{i}", i, "old") for i in range(200)}
    frame = lambda some: spark.createDataFrame(list(some), "key string, n long, v string")
    upserts.in_buckets(frame(rows.values()), "key", path, 8)
    before = files(path)
    batch = [("k3", 500, "new"), ("k3", 400, "lost"), ("fresh", 1, "x"), ("fresh", 0, "y"), ("k9", 9, "old"), (None, 1, "z"), ("k4", 600, None)]
    counts = upserts.upsert_in_place(path, frame(batch), "key", "n", 8)
    rows |= {"k3": batch[0], "fresh": batch[2], "k4": batch[6]}
    table = spark.read.schema("key string, n long, v string").parquet(path).select("key", "n", "v")
    assert {r.key: tuple(r) for r in table.collect()} == rows and table.count() == len(rows)
    assert counts == {"processed": 6, "inserted": 1, "updated": 5, "rewritten": counts["rewritten"]} and 1 <= counts["rewritten"] <= 3
    after = files(path)
    assert len(before & after) == len(before) - counts["rewritten"]
    assert upserts.upsert_in_place(path, frame(batch), "key", "n", 8)["rewritten"] == 0 and files(path) == after
    assert upserts.upsert_in_place(path, frame([]), "key", "n", 8)["rewritten"] == 0 and files(path) == after


def test_postings_kept_at_write(spark, tmp_path):
    rng = random.Random(2)
    words = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) for _ in range(rng.randint(0, 8)))
    store, held = kept.KeptPostings(spark, str(tmp_path / "kept"), buckets=4), {}
    for n in range(3):
        batch = {i: words() if i % 5 else None for i in rng.sample(range(40), 15)}
        gone = rng.sample(range(40), 4) if n else []
        store.write(spark.createDataFrame(list(batch.items()), "doc_id long, text string"), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        held = {i: t for i, t in (held | batch).items() if i not in gone}
    anew = postings.postings(spark.createDataFrame(list(held.items()), "doc_id long, text string"))
    plain = lambda df: sorted((r.term, r.doc_id, r.tf, tuple(r.positions)) for r in df.collect())
    sums = lambda df: sorted(map(tuple, df.collect()))
    want = sums(anew.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    assert {r.doc_id for r in store.documents().collect()} == set(held)
    smaller = store.compact(str(tmp_path / "compact"))
    for one in (store, smaller):
        assert plain(one.postings()) == plain(anew) and sums(one.totals()) == want


def test_a_batch_reads_only_what_it_changes(spark, tmp_path):
    """The third batch's plan filters the stored postings to the buckets of its documents."""
    store = kept.KeptPostings(spark, str(tmp_path / "kept"), buckets=8)
    store.write(spark.createDataFrame([(i, "one two") for i in range(50)], "doc_id long, text string"))
    half = files(str(tmp_path / "kept/postings"))
    store.write(spark.createDataFrame([(1, "three")], "doc_id long, text string"))
    assert half < files(str(tmp_path / "kept/postings"))
    assert {r.term: (r.df, r.cf) for r in store.totals().collect()} == {"one": (49, 49), "two": (49, 49), "three": (1, 1)}


def test_processors_hold_one_piece_of_a_key():
    """Results come out before the next piece is taken in, and rows out of order are refused."""
    from unittest.mock import Mock

    taken = []

    def pieces(starts):
        for start in starts:
            taken.append(start)
            ids = np.arange(start, start + 100)
            yield pd.DataFrame({"ts": pd.to_datetime(ids, unit="s"), "event_id": ids, "value": ids % 7 * 5.0})

    window = state.LatencyWindow()
    window.held = Mock(exists=lambda: False)
    made = window.handleInputRows(("a",), pieces([0, 100, 200]), None)
    some = [next(made)]
    assert taken == [0]
    some += list(made)
    whole = state.LatencyWindow()
    whole.held = Mock(exists=lambda: False)
    want = pd.concat(whole.handleInputRows(("a",), iter([pd.concat(pieces([0, 100, 200]))]), None))
    assert pd.concat(some)["timeout"].tolist() == want["timeout"].tolist()
    assert window.held.put.call_args == whole.held.put.call_args and len(window.held.put.call_args[0][0]) == 50
    with pytest.raises(ValueError, match="not in order"):
        list(window.handleInputRows(("a",), pieces([100, 0]), None))
