"""Removal of word windows that an earlier document already has, by level-wise doubling.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word is removed if it lies in a window of ``window`` words
of its document whose word sequence also starts in a document with a smaller doc_id; windows are judged
on the input. Two levels reach the window: windows of half its length (rounded up) that occur in one
document alone are dropped, and only the others are doubled (two overlapping halves) and compared again.

Level one keeps, of every ``window`` words, the half-length window with the smallest hash (leftmost in a
tie). Equal windows choose the same one, so a repeated window always has a repeated half and no other
half needs to be compared. Each task first settles what its own batch can settle: a half or window seen
in several documents of a batch needs one row to tell the others and none to ask. So a key has at most
one asking document for each batch, however common its passage is, and the sorted streams that compare
keys hold one key at a time. Level two only looks at the windows whose half survived, and ends the work
if none did. Hashes are 64 bits at level one (a collision costs a comparison) and 96 bits at level two.

Defined cases: null or empty text has no words; texts of fewer words than the window keep everything;
rows that share a doc_id are never earlier than each other; a null doc_id is neither earlier nor later
than another, so its row keeps everything; repeated rows are returned each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.storage import materialize

BASE, STIR1, STIR2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
CACHE, ROWS = 400_000, 512
ASK, TELL, DONE = 0, 1, 2


class WordHashes(dict):
    """Word → XXH64, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 5)
        return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * STIR1
    x = (x ^ (x >> np.uint64(27))) * STIR2
    return x ^ (x >> np.uint64(31))


class Layout:
    """The words of many texts laid end to end, with their half-window hashes."""

    def __init__(self, texts: list[str | None], hashes: WordHashes, window: int):
        lists = [words_of(t) for t in texts]
        self.window, self.half = window, -(-window // 2)
        sizes = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), np.uint64, total)
        self.owner = np.repeat(np.arange(len(lists)), sizes)
        self.place = np.arange(total) - self.first[self.owner]
        left = sizes[self.owner] - self.place  # words from here to the end of the text
        n = max(0, total - self.half + 1)
        poly = np.zeros(n, np.uint64)
        for j in range(self.half):
            poly = poly * BASE + h[j : j + n]
        self.halves = _stir(poly)
        self.starts = np.flatnonzero(left >= window)  # where a whole window starts

    def chosen(self) -> np.ndarray:
        """For each of ``starts``: the position of its window's smallest half hash, leftmost in a tie."""
        best, at = self.halves[self.starts], self.starts.copy()
        for j in range(1, self.window - self.half + 1):
            other = self.halves[self.starts + j]
            less = other < best
            best = np.where(less, other, best)
            at[less] = self.starts[less] + j
        return at

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64- and 32-bit hashes of the windows at ``starts``: two overlapping halves each."""
        a, b = self.halves[starts], self.halves[starts + self.window - self.half]
        low = _stir(a * BASE + b)
        return low, (_stir(b * STIR2 + (a ^ STIR1)) >> np.uint64(32)).astype(np.uint32)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal sorted keys."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _spread(n: int, seed: np.ndarray) -> np.ndarray:
    """Keys for rows that need no comparison: even over the partitions."""
    return _stir(seed.astype(np.uint64) * BASE + np.arange(n, dtype=np.uint64)).view(np.int64)


def _level_one(window: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lay = Layout(part.column(1).to_pylist(), hashes, window)
                where = np.unique(lay.chosen())
                if not len(where):
                    continue
                doc = np.asarray(part.column(0))[lay.owner[where]]
                key, pos = lay.halves[where], lay.place[where]
                order = np.lexsort((doc, key))
                key, doc, pos = key[order], doc[order], pos[order]
                cut = _groups(key)
                last = np.concatenate((cut[1:], [len(key)])) - 1
                several = doc[cut] != doc[last]
                group = np.repeat(np.arange(len(cut)), last + 1 - cut)
                settled = several[group]
                tell = cut[several]
                out_key = np.concatenate((key[~settled].view(np.int64), key[tell].view(np.int64), _spread(int(settled.sum()), pos[settled])))
                out_doc = np.concatenate((doc[~settled], doc[tell], doc[settled]))
                out_pos = np.concatenate((pos[~settled], pos[tell], pos[settled])).astype(np.int32)
                kind = np.repeat(np.array([ASK, TELL, DONE], np.int32), [int((~settled).sum()), len(tell), int(settled.sum())])
                near = np.lexsort((out_pos, out_doc))  # neighbours share their doc: smaller shuffle files
                yield pa.RecordBatch.from_arrays([pa.array(x[near]) for x in (out_key, out_doc, out_pos << 2 | kind)], names=["key", "doc", "pos"])

    return run


def _sorted_keys(batches):
    """Chunks of batches sorted by their first column that never split a key: lists of columns."""
    rest = None
    for batch in batches:
        part = [np.asarray(c) for c in batch.columns]
        if rest is not None:
            part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
        if not len(part[0]):
            continue
        at = int(_groups(part[0])[-1])
        rest = [x[at:] for x in part]
        if at:
            yield [x[:at] for x in part]
    if rest is not None and len(rest[0]):
        yield rest


def _survivors(batches):
    """Level one compared: asking rows whose half occurs in another document, and the settled rows."""
    for key, doc, pos in _sorted_keys(batches):
        kind, pos = pos & 3, pos >> 2
        cut = _groups(key)
        size = np.diff(np.concatenate((cut, [len(key)])))
        low, high = np.minimum.reduceat(doc, cut), np.maximum.reduceat(doc, cut)
        repeated = np.repeat((low != high) | (np.maximum.reduceat(kind * (kind == TELL), cut) > 0), size)
        keep = (kind == DONE) | (repeated & (kind == ASK))
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep])], names=["doc", "pos"])


def _level_two(window: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lay = Layout(part.column(1).to_pylist(), hashes, window)
                lists = part.column(3)
                counts = np.array([len(x) for x in lists], np.int64)
                alive = np.zeros(len(lay.owner), bool)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(counts)), counts)
                sizes = np.diff(np.concatenate((lay.first, [len(lay.owner)])))
                inside = flat < sizes[owner]  # another text of the same doc_id may be shorter
                alive[(lay.first[owner] + flat)[inside]] = True
                starts = lay.starts[alive[lay.chosen()]]
                if not len(starts):
                    continue
                low, more = lay.windows(starts)
                doc, tag = np.asarray(part.column(0))[lay.owner[starts]], np.asarray(part.column(2))[lay.owner[starts]]
                pos = lay.place[starts]
                order = np.lexsort((pos, doc, more, low))
                low, more, doc, tag, pos = (x[order] for x in (low, more, doc, tag, pos))
                cut = _groups(low, more)
                group = np.repeat(np.arange(len(cut)), np.diff(np.concatenate((cut, [len(low)]))))
                later = doc > doc[cut][group]
                key = np.concatenate((low[~later].view(np.int64), _spread(int(later.sum()), pos[later])))
                kind = np.repeat(np.array([ASK, DONE], np.int64), [int((~later).sum()), int(later.sum())])
                more, doc, tag, pos = (np.concatenate((x[~later], x[later])) for x in (np.where(later, np.uint32(0), more).view(np.int32), doc, tag.astype(np.int64), pos))
                near = np.lexsort((pos, doc))
                yield pa.RecordBatch.from_arrays([pa.array(x[near]) for x in (key, doc, tag << 34 | pos << 2 | kind, more)], names=["key", "doc", "at", "more"])

    return run


def _marked(batches):
    """Level two compared: starts of windows that a smaller doc_id also has."""
    for key, doc, at, more in _sorted_keys(batches):
        asking = at & 3 == ASK
        done_doc, done_at = [doc[~asking]], [at[~asking]]
        key, doc, at, more = (x[asking] for x in (key, doc, at, more))
        if len(key):
            order = np.lexsort((doc, more, key))
            key, doc, at, more = (x[order] for x in (key, doc, at, more))
            cut = _groups(key, more)
            later = doc > np.repeat(doc[cut], np.diff(np.concatenate((cut, [len(key)]))))
            done_doc.append(doc[later])
            done_at.append(at[later])
        at = np.concatenate(done_at)
        found = [np.concatenate(done_doc), (at >> 34).astype(np.int32), (at >> 2 & 0xFFFFFFFF).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["doc", "tag", "pos"])


def marked_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """``doc, tag, starts``: for every document (id and a tag of its text) the windows to remove; a table."""
    spark = docs.sparkSession
    tag = F.pmod(F.xxhash64("text"), F.lit(1 << 24)).cast("int")
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc IS NOT NULL AND text IS NOT NULL")
    asked = own.mapInArrow(_level_one(window), "key long, doc long, pos int").repartition("key").sortWithinPartitions("key")
    alive = asked.mapInArrow(_survivors, "doc long, pos int").groupBy("doc").agg(F.collect_list("pos").alias("at"))
    alive = materialize(alive, "half-windows")
    if alive.isEmpty():
        return spark.createDataFrame([], "doc long, tag int, starts array<int>")
    both = own.join(alive.withColumnRenamed("doc", "alive_doc"), F.col("doc") == F.col("alive_doc")).select("doc", "text", tag.alias("tag"), "at")
    asked = both.mapInArrow(_level_two(window), "key long, doc long, at long, more int")
    asked = asked.repartition("key").sortWithinPartitions("key")
    found = asked.mapInArrow(_marked, "doc long, tag int, pos int").groupBy("doc", "tag").agg(F.collect_list("pos").alias("starts"))
    found = materialize(found, "windows")
    return found


def substring_dedup(docs: DataFrame, window: int = 13, digests: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the kept text (``kept``; with ``digests`` its SHA-256 alone)."""
    marks = marked_windows(docs, window)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own.withColumn("own_tag", F.pmod(F.xxhash64("text"), F.lit(1 << 24)).cast("int"))
    joined = own.join(marks, (F.col("doc_id") == F.col("doc")) & (F.col("own_tag") == F.col("tag")), "left").select("doc_id", "text", "starts")
    name = "kept_sha256" if digests else "kept"

    def run(batches):
        for batch in batches:
            rows = []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                kept = words
                if starts.is_valid and len(starts):
                    at = starts.values.to_numpy(zero_copy_only=False)
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    kept = [w for w, covered in zip(words, np.cumsum(step)[:-1].tolist(), strict=True) if not covered]
                flat = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(flat).hexdigest() if digests else flat.decode("utf-8", "replace")))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")


def oracle(window: int = 13) -> str:
    last = window - 1
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {last} + 1)) AS i FROM d WHERE len(w) >= {window}),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {last}), ' ') AS t FROM p),
m AS (SELECT t, min(doc_id) AS low FROM k GROUP BY t),
c AS (SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + {window})) AS j FROM k JOIN m ON k.t = m.t WHERE m.low < k.doc_id),
r AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""
