"""Latest rows as a resumable stream: one batch run, stopped and restarted runs, late rows, and the size of the state."""

import datetime
import random

import pytest

from patchloom.streaming import latest

SCHEMA = "k string, t timestamp, o long, p string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


@pytest.fixture
def store(spark):
    before = spark.conf.get(latest.STORE[0])
    latest.use_state_store(spark)
    yield
    spark.conf.set(latest.STORE[0], before)


class Run:
    """A stream over the files of a folder, with the last row given for each key and the state's sizes."""

    def __init__(self, spark, folder, tmp_path, late="60 minutes"):
        self.spark, self.folder, self.checkpoint, self.late = spark, folder, f"file://{tmp_path}/checkpoint", late
        self.rows, self.sizes = {}, []

    def put(self, name, rows):
        part = self.spark.createDataFrame(rows, SCHEMA).coalesce(1)
        part.write.parquet(f"file://{self.folder}/{name}")

    def go(self):
        def keep(frame, _):
            self.rows.update({r.k: (r.t, r.o, r.p) for r in sorted(frame.collect(), key=lambda r: (r.k, r.t, -r.o))})

        source = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{self.folder}")
        found = latest.latest_rows(source, "k", "t", "o", "p", self.late)
        query = found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
        self.sizes += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        return self.rows


def test_restarts_give_the_rows_of_one_batch_run(spark, tmp_path, store):
    r = random.Random(4)
    parts = [[(f"k{r.randrange(12)}", at(40 * i + r.randrange(60)), r.randrange(3), f"p{i}-{j}") for j in range(30)] for i in range(4)]
    parts[1] += [("k1", None, 1, "no time"), (None, at(50), 1, "no key"), ("null", at(50), 1, None)]
    parts = [list({(k, t, o): (k, t, o, p) for k, t, o, p in part}.values()) for part in parts]
    run = Run(spark, tmp_path / "in", tmp_path)
    run.put("a", parts[0]), run.put("b", parts[1])
    run.go()
    run.put("c", parts[2])
    run.go()
    run.put("d", parts[3])
    found = run.go()
    best = {}
    for k, t, o, p in (row for part in parts for row in part if None not in row[:3]):
        if k not in best or (t, -o) > (best[k][0], -best[k][1]):
            best[k] = (t, o, p)
    assert found == best


def test_late_rows_bring_nothing_and_state_is_dropped(spark, tmp_path, store):
    run = Run(spark, tmp_path / "in", tmp_path)
    for i in range(5):
        run.put(f"f{i}", [(f"hour {i}, {j}", at(200 * i), 0, "x") for j in range(20)])
        run.go()
    run.put("late", [("hour 0, 0", at(0) + datetime.timedelta(seconds=1), 0, "late"), ("new", at(801), 0, "y")])
    found = run.go()
    assert found["hour 0, 0"] == (at(0), 0, "x") and found["new"][2] == "y" and len(found) == 101
    assert max(run.sizes) < 3 * 20 * 4 and run.sizes[-1] < 2 * 21 * 4
