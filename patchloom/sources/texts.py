"""One text file a row, with a commit: a Python data source whose tasks write aside and whose driver decides.

Every task attempt writes its files and a list of their names into a folder of its own under ``_staging-*``. Only when all
tasks have ended does the driver write the marker ``_committed`` with the attempts that count; files of failed, repeated or
speculative attempts are never named in it. Then tasks move the counted files to their places, a step that may be repeated
or taken up again later (:func:`finish_texts`), and the staging folder goes. A job that fails leaves no file behind.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Names of the staging folder (hidden from Spark's readers), its marker, and in an attempt's folder the list of names and the files.
STAGING, MARKER, NAMES, FILES = "_staging-", "_committed", "names.json", "files"


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:/") else f"file://{folder}")


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


@dataclass
class Attempt(WriterCommitMessage):
    name: str
    files: int


class TextsWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, staging: str):
        self.folder, self.staging = folder, staging

    def write(self, iterator):
        store, root = open_store(self.folder)
        own, names = uuid.uuid4().hex, []
        try:
            for batch in iterator:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not name or name.startswith("/") or ".." in name.split("/"):
                        raise ValueError(f"no file can be called {name!r}")
                    _put(store, f"{root}/{self.staging}/{own}/{FILES}/{name}", (text or "").encode())
                    names.append(name)
            _put(store, f"{root}/{self.staging}/{own}/{NAMES}", "\n".join(json.dumps({"attempt": own, "name": n}) for n in names).encode())
        except Exception:
            if store.get_file_info(f"{root}/{self.staging}/{own}").type == fs.FileType.Directory:
                store.delete_dir(f"{root}/{self.staging}/{own}")
            raise
        return Attempt(own, len(names))

    def commit(self, messages):
        store, root = open_store(self.folder)
        _put(store, f"{root}/{self.staging}/{MARKER}", json.dumps({m.name: m.files for m in messages if m and m.files}).encode())

    def abort(self, messages):
        store, root = open_store(self.folder)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class TextsSource(DataSource):
    """``texts``: rows (name string, text string); options ``path`` and ``staging``."""

    @classmethod
    def name(cls):
        return "texts"

    def schema(self):
        return "name string, text string"

    def writer(self, schema, overwrite):
        return TextsWriter(self.options["path"], self.options["staging"])


def write_texts(frame: DataFrame, folder: str, name: str, text: str) -> None:
    """One file for each row below ``folder``, called by the row's ``name`` (slashes make folders); null text is an empty file.

    A name that occurs twice, is empty or null or leads out of the folder is an error, and nothing is written. Files that stand
    at the same places are replaced."""
    spark = frame.sparkSession
    rows = frame.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    twice = rows.groupBy("name").count().where("count > 1").first()
    if twice:
        raise ValueError(f"{twice['count']} rows are called {twice['name']!r}")
    spark.dataSource.register(TextsSource)
    staging = STAGING + uuid.uuid4().hex
    rows.write.format("texts").option("path", folder).option("staging", staging).mode("append").save()
    finish_texts(spark, folder)


def finish_texts(spark: SparkSession, folder: str) -> int:
    """Moves the files of every committed staging folder to their places and drops it; returns the number of such folders.

    Safe to repeat: a file that has been moved is passed by. Staging folders without a marker are of unfinished writes and stay."""
    store, root = open_store(folder)
    found = [x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.startswith(STAGING)]
    done = [s for s in found if store.get_file_info(f"{root}/{s}/{MARKER}").type == fs.FileType.File]
    for staging in done:
        with store.open_input_file(f"{root}/{staging}/{MARKER}") as marker:
            attempts = json.loads(marker.read())
        if attempts:
            names = spark.read.schema("attempt string, name string").json([f"{folder}/{staging}/{a}/{NAMES}" for a in attempts])
            moved = names.mapInArrow(_mover(folder, staging), "n long").agg(F.sum("n")).first()[0]
            if moved != sum(attempts.values()):
                raise RuntimeError(f"{staging} lists {moved} of {sum(attempts.values())} files; it is kept")
        store.delete_dir(f"{root}/{staging}")
    return len(done)


def _mover(folder: str, staging: str):
    def run(batches):
        store, root = open_store(folder)
        for batch in batches:
            for attempt, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, place = f"{root}/{staging}/{attempt}/{FILES}/{name}", f"{root}/{name}"
                if store.get_file_info(source).type == fs.FileType.File:
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    store.move(source, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run
