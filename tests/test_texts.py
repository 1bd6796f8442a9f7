"""The sink of text files: whole copies, failed and repeated attempts, interrupted moves."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchloom.sources import texts


def tree(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())], names=["name", "text"])


def test_every_row_is_a_file(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/"), "id", F.lit(".txt")).alias("n"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("é\n"), "id")).alias("t"))
    texts.write_texts(rows.repartition(6), f"file://{tmp_path}/out", "n", "t")
    assert tree(tmp_path / "out") == {f"d{i % 7}/{i}.txt": f"é\n{i}" if i % 10 else "" for i in range(500)}
    texts.write_texts(rows.limit(1).withColumn("t", F.lit("new")), f"file://{tmp_path}/out", "n", "t")
    assert list(tree(tmp_path / "out").values()).count("new") == 1 and len(tree(tmp_path / "out")) == 500


@pytest.mark.parametrize("bad", [None, "", "/etc/x", "a/../../x"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    rows = spark.createDataFrame([(f"f{i}", "t") for i in range(50)] + [(bad, "t")], "n string, t string")
    with pytest.raises(Exception):
        texts.write_texts(rows.repartition(3), f"file://{tmp_path}/out", "n", "t")
    assert tree(tmp_path) == {}


def test_repeated_names_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("a", "2")], "n string, t string")
    with pytest.raises(ValueError, match="2 rows"):
        texts.write_texts(rows, str(tmp_path / "out"), "n", "t")
    assert tree(tmp_path) == {}


def test_a_task_that_fails_once_leaves_one_whole_copy(spark, tmp_path):
    """The first attempt dies half way, the second ends twice (speculation); one of its copies is committed."""
    folder = f"file://{tmp_path}"
    writer = texts.TextsWriter(folder, texts.STAGING + "x")
    rows = [(f"s/{i}", f"text {i}") for i in range(20)]

    def dies():
        yield batch(rows[:10])
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dies())
    assert tree(tmp_path) == {}
    one, two = writer.write(iter([batch(rows)])), writer.write(iter([batch(rows)]))
    assert one.files == two.files == 20
    assert texts.finish_texts(spark, folder) == 0  # nothing is committed yet
    writer.commit([two, None])
    assert texts.finish_texts(spark, folder) == 1
    assert tree(tmp_path) == dict(rows) and texts.finish_texts(spark, folder) == 0


def test_an_interrupted_move_is_taken_up_again(spark, tmp_path):
    folder = f"file://{tmp_path}"
    writer = texts.TextsWriter(folder, texts.STAGING + "y")
    done = writer.write(iter([batch([("a", "1"), ("b/c", "2"), ("d", None)])]))
    writer.commit([done])
    (tmp_path / (texts.STAGING + "y") / done.name / texts.FILES / "a").rename(tmp_path / "a")
    assert texts.finish_texts(spark, folder) == 1
    assert tree(tmp_path) == {"a": "1", "b/c": "2", "d": ""}
