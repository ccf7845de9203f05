"""Buckets of an incremental index: what is rewritten, equality with a rebuild, stops within a batch."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events as streams
from tessera.streaming import views

STATE, POINTS = "path string, symbols string", "path string, id string, text string"


def process(rows):
    return rows.select("path", F.upper("content").alias("symbols"))


def chunk(rows):
    return rows.select("path", F.explode(F.array(F.lit("#1"), F.lit("#2"))).alias("n"), "symbols").select("path", F.concat("path", "n").alias("id"), F.col("symbols").alias("text"))


def size(folder, number):
    return sum(p.stat().st_size for part in views.PARTS for p in Path(folder, part, f"v={number}").rglob("*.parquet"))


def rows_of(spark, folder):
    return sorted(map(tuple, views.read_view(spark, folder, "state", STATE).collect())), sorted(map(tuple, views.read_view(spark, folder, "points", POINTS).collect()))


def expected(files):
    return sorted((p, c.upper()) for p, (_, c) in files.items()), sorted((p, f"{p}#{n}", c.upper()) for p, (_, c) in files.items() for n in (1, 2))


def test_a_batch_rewrites_what_its_changes_touch(spark, tmp_path):
    r = random.Random(1)
    folder, files = str(tmp_path / "view"), {f"src/{n}.py": ("1", "".join(r.choices("abcdef", k=400))) for n in range(600)}
    assert views.read_view(spark, folder, "state", STATE).count() == 0

    def step(number):
        rows = [(p, h, c) for p, (h, c) in files.items()]
        return views.apply_snapshot(spark.createDataFrame(rows, "path string, hash string, content string"), number, folder, process, chunk, STATE, POINTS)

    assert len(step(0)) == views.BUCKETS and rows_of(spark, folder) == expected(files)
    files["src/7.py"] = ("2", "changed")
    del files["src/9.py"]
    files["src/new.py"] = ("1", "new")
    touched = step(1)
    assert 1 <= len(touched) <= 3 and rows_of(spark, folder) == expected(files)
    assert size(folder, 1) < size(folder, 0) / 10
    assert step(1) == [] and step(2) == [] and size(folder, 2) == 0  # done already; nothing changed
    files.clear()
    files["only"] = ("1", "x")
    step(3)
    assert rows_of(spark, folder) == expected(files)
    assert views.remove_unused(spark, folder) and rows_of(spark, folder) == expected(files)


def test_a_stop_within_a_batch_leaves_the_old_version(spark, tmp_path):
    folder, where, checkpoint, flag = str(tmp_path / "view"), str(tmp_path / "in"), str(tmp_path / "c"), tmp_path / "fail"

    def failing(rows):
        if flag.exists():
            raise RuntimeError("stopped")
        return chunk(rows)

    def run(snapshot):
        if snapshot:
            spark.createDataFrame(snapshot, "path string, hash string, content string").coalesce(1).write.mode("append").parquet(where)
        stream = streams.read_stream(spark, where, "path string, hash string, content string", 1)
        views.maintain_view(stream, folder, process, failing, STATE, POINTS, checkpoint, 4).awaitTermination(120)

    run([("a", "1", "x"), ("b", "1", "y")])
    flag.touch()
    with pytest.raises(Exception, match="stopped"):
        run([("a", "2", "z"), ("c", "1", "w")])
    assert [s for s, _ in rows_of(spark, folder)[0]] == ["a", "b"] and rows_of(spark, folder)[0][0] == ("a", "X")
    flag.unlink()
    run(None)
    assert rows_of(spark, folder)[0] == [("a", "Z"), ("c", "W")] and [i for _, i, _ in rows_of(spark, folder)[1]] == ["a#1", "a#2", "c#1", "c#2"]
