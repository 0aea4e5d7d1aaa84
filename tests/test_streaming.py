"""Followed files: changes by state, whatever the batches and restarts, beside a plain loop."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from loam.streaming import updates

SCHEMA, START, GONE = "path string, hash string, seen timestamp", datetime(2024, 3, 30, tzinfo=timezone.utc), timedelta(hours=5)


def expected(rows, late):
    out, ends = [], START + max(t for _, _, t in rows) - late
    for path in sorted({p for p, _, _ in rows if p}):
        known = None
        for t, there, digest in sorted((t, h is not None, h or "") for p, h, t in rows if p == path):
            if known and t > known[1] + GONE:
                out.append((path, "removed", None, known[1] + GONE))
                known = None
            if there and (not known or known[0] != digest):
                out.append((path, "changed" if known else "added", digest, t))
            elif known and not there:
                out.append((path, "removed", None, t))
            known = (digest, t) if there else None
        if known and START + known[1] + GONE < ends:
            out.append((path, "removed", None, known[1] + GONE))
    return sorted(((p, c, h, START + t) for p, c, h, t in out), key=str)


def fed(spark, folder, rows, number):
    made = [(p, h, START + t) for p, h, t in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={number}")


def follow(spark, folder, per_trigger=1000):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/in")
    seen = []
    run = lambda diff, n: seen.append((n, sorted((r.path, r.change) for r in diff.collect())))
    updates.follow_files(stream, f"{folder}/out", f"{folder}/check", run, GONE, "1 minute", once=True).awaitTermination()
    return seen


def changes(spark, folder):
    found = spark.read.parquet(f"{folder}/out/changes").select("path", "change", "hash", F.unix_micros("at").alias("us")).collect()
    return sorted(((r.path, r.change, r.hash, datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=r.us)) for r in found), key=str)


def test_changes_do_not_depend_on_batches_or_restarts(spark, tmp_path):
    rng = random.Random(8)
    times = sorted(rng.randrange(60 * 3600) for _ in range(300))
    rows = [(rng.choice("abcdefgh"), rng.choice(["1", "1", "1", "2", None]), timedelta(seconds=s, microseconds=rng.randrange(10**6))) for s in times]
    rows += [(None, "1", rows[-1][2]), rows[-1], ("once", "9", timedelta(seconds=1))]
    rows.sort(key=lambda r: r[2])
    want = expected(rows, timedelta(minutes=1))
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    fed(spark, whole, rows, 0)
    follow(spark, whole)
    for n in range(3):  # each part is read by a new query that goes on from the checkpoint
        fed(spark, parts, rows[n * 101 : (n + 1) * 101], n)
        follow(spark, parts)
    assert changes(spark, whole) == want and changes(spark, parts) == want
    last = {}
    for path, change, digest, _ in sorted(want, key=lambda r: (r[3], r[1] != "removed")):
        last[path] = digest
    there = {(p, h) for p, h in last.items() if h is not None}
    assert {tuple(r) for r in updates.manifest(spark, f"{parts}/out").collect()} == there
    updates.fold_changes(spark, f"{parts}/out", 1)
    updates.fold_changes(spark, f"{parts}/out", 1)
    assert {tuple(r) for r in updates.manifest(spark, f"{parts}/out").collect()} == there
    updates.fold_changes(spark, f"{parts}/out", 99)
    assert {tuple(r) for r in updates.manifest(spark, f"{parts}/out").collect()} == there


def test_a_batch_run_again_and_a_batch_of_its_own_size(spark, tmp_path):
    """A batch whose commit is lost is run again and gives the same; a batch's changes are its own paths'."""
    folder = str(tmp_path)
    fed(spark, folder, [(f"p{i}", "1", timedelta(0)) for i in range(500)], 0)
    first = follow(spark, folder)
    fed(spark, folder, [("p7", "2", timedelta(minutes=3)), ("p8", "1", timedelta(minutes=3))], 1)
    second = follow(spark, folder)
    found = [c for _, some in second for c in some]
    assert sum(len(some) for _, some in first) == 500 and found == [("p7", "changed")]
    before = changes(spark, folder)
    commits = sorted((tmp_path / "check" / "commits").iterdir(), key=lambda f: f.name)
    number = max(int(f.name) for f in commits if f.name.isdigit())
    for f in commits:
        if f.name in (str(number), f".{number}.crc"):
            f.unlink()
    assert follow(spark, folder) is not None and changes(spark, folder) == before
