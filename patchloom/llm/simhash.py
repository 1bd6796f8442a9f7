"""SimHash fingerprints and near-duplicate classes by covering locality-sensitive hashing.

Fingerprint: the text with A-Z lower-cased, its words ``[^\\x20\\x09-\\x0D]+``, ``shingle``-word shingles
(repeats included; fewer words: the whole sequence; none: fingerprint zero), XXH64 with seed 42 of each;
a bit is 1 if it is set in more than half of the hashes.

Links: two fingerprints that differ in at most ``radius`` bits. Covering: every bit position i gets a
nonzero vector m(i) of radius + 1 bits; for each nonzero v the mask keeps the positions with odd
<m(i), v>. Any ``radius`` positions leave a v orthogonal to all their vectors, so every linked pair
agrees under at least one of the 2^(radius+1) - 1 masks: no link is missed. Only distinct fingerprints
are bucketed, so copies cost one row. Buckets of up to ``bucket_limit`` fingerprints are verified by
exact Hamming distance as they stand; a larger bucket is cut again by dropping ``radius`` of six (then
five) blocks of its free bits, which misses no pair either and ends in buckets of bounded size.

Defined cases: null or empty text has fingerprint zero and links like any other; a null doc_id takes
part, and component ids are the smallest non-null id of the class (null if there is none); repeated rows
are returned each; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.columns import fresh
from patchloom.llm.components import components
from patchloom.storage import materialize


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    hash64 = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([hash64(flat[a:b], 42) for a, b in spans], dtype=">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, th, fp`` (text hash, fingerprint as a signed bigint) of every row; one narrow pass over the texts."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, fp long")


def covering_masks(radius: int = 3, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks; position i carries the vector 1 + i mod (2^(radius+1) - 1)."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((1 + i % n) & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(free: int, blocks: int, radius: int) -> list[int]:
    """Masks over the ``free`` positions that drop any ``radius`` of ``blocks`` even blocks."""
    at = [i for i in range(64) if free >> i & 1]
    parts = [sum(1 << i for i in at[b::blocks]) for b in range(blocks)]
    return [free & ~sum(parts[i] for i in drop) for drop in combinations(range(blocks), radius)]


def _local_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one bucket; exact, breadth first."""
    open_, links = np.arange(len(fp)), []
    while len(open_):
        root, open_ = open_[0], open_[1:]
        queue = [root]
        while queue and len(open_):
            at = queue.pop()
            near = np.bitwise_count(fp[open_] ^ fp[at]) <= radius
            found = open_[near]
            links += [(at, x) for x in found.tolist()]
            queue += found.tolist()
            open_ = open_[~near]
    return links


def _bucket_links(radius: int):
    """Reads rows sorted by bucket (v, key) and yields spanning links; holds one bucket at a time."""

    def links(v: np.ndarray, key: np.ndarray, fp: np.ndarray):
        cut = np.flatnonzero((v[1:] != v[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
        sizes = ends - starts
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        out = [np.stack([fp[near], fp[near + 1]], axis=1)]
        for a, b in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
            if pairs := _local_links(fp[a:b], radius):
                out.append(fp[a:b][np.array(pairs)])
        return np.concatenate(out)

    def run(batches):
        rest = None
        for batch in batches:
            part = [np.asarray(c) for c in (batch.column(0), batch.column(1), batch.column(2))]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
            v, key, fp = part
            if not len(fp):
                continue
            last = np.flatnonzero((v != v[-1]) | (key != key[-1]))
            at = int(last[-1]) + 1 if len(last) else 0
            rest = [x[at:] for x in part]
            if at:
                found = links(v[:at], key[:at], fp[:at].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])
        if rest is not None and len(rest[2]):
            found = links(rest[0], rest[1], rest[2].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return run


def _bucketed(fps: DataFrame, masks: list[tuple[int, int]], name: str) -> DataFrame:
    """(v, key, fp) of every fingerprint under every (number, mask)."""
    keys = F.array(*[F.struct(F.lit(n).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for n, m in masks])
    return fps.select("fp", F.explode(keys).alias(name)).select(f"{name}.v", f"{name}.key", "fp")


def links(fps: DataFrame, radius: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """``u, v``: links between distinct fingerprints ``fp`` that span every class within ``radius`` bits.

    One counting shuffle over the mask keys (map-side combined) tells the buckets of two or more; only
    their members are shuffled again. A bucket over ``bucket_limit`` is cut by further masks over its free
    bits, twice at most, until the number of free bits bounds it."""
    masks = list(enumerate(covering_masks(radius)))
    rows = _bucketed(fps, masks, "m0")
    counts = rows.groupBy("v", "key").count().where("count > 1").withColumnsRenamed({"v": "bv", "key": "bkey"})
    members = materialize(rows.join(counts, (F.col("v") == F.col("bv")) & (F.col("key") == F.col("bkey"))).select("v", "key", "fp", F.col("count").alias("n")), "buckets")
    parts, left, plan = [members.where(F.col("n") <= bucket_limit)], members.where(F.col("n") > bucket_limit), [(m, n) for n, m in masks]
    numbers = {n: m for m, n in plan}
    for blocks in (6, 5):
        if left.isEmpty():
            break
        keys, fresh = None, {}
        for number, mask in numbers.items():
            subs = block_masks(~mask & (1 << 64) - 1, blocks, radius)
            items = []
            for i, sub in enumerate(subs):
                fresh[number * 64 + i + 1000] = mask | sub
                items.append(F.struct(F.lit(number * 64 + i + 1000).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(mask | sub))).alias("key")))
            keys = F.when(F.col("v") == number, F.array(*items)) if keys is None else keys.when(F.col("v") == number, F.array(*items))
        rows = left.select("fp", F.explode(keys).alias(f"m{blocks}")).select(f"m{blocks}.v", f"m{blocks}.key", "fp").distinct()
        counts = rows.groupBy("v", "key").count().where("count > 1").withColumnsRenamed({"v": "bv", "key": "bkey"})
        cut = materialize(rows.join(counts, (F.col("v") == F.col("bv")) & (F.col("key") == F.col("bkey"))).select("v", "key", "fp", F.col("count").alias("n")), "buckets")
        # after the second cut at most 2^(two fifths of what the first cut left free) fingerprints can share a bucket
        parts.append(cut.where(F.col("n") <= bucket_limit) if blocks == 6 else cut)
        left = cut.where(F.col("n") > bucket_limit)
        numbers = {v: fresh[v] for v in sorted(r[0] for r in left.select("v").distinct().collect())} if blocks == 6 and not left.isEmpty() else {}
        if not numbers:
            break
    small = parts[0]
    for p in parts[1:]:
        small = small.unionByName(p)
    ordered = small.select("v", "key", "fp").repartition("v", "key").sortWithinPartitions("v", "key", "fp")
    return ordered.mapInArrow(_bucket_links(radius), "u long, v long").distinct()


def _classes(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and the class root of each distinct fingerprint."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    labels = components(links(distinct.select("fp"), radius))
    named = distinct.join(labels, F.col("fp") == F.col("node"), "left")
    return prints, named.select(F.col("fp").alias("cfp"), "first_id", F.coalesce("label", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    prints, named = _classes(docs, shingle, radius)
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "of")
    classes = materialize(named.join(lowest, F.col("root") == F.col("of")).select("cfp", "component_id"), "classes")
    joined = prints.join(classes, F.col("fp") == F.col("cfp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` (all columns) for each class: that of the smallest doc_id, null last, then text hash, then the
    hash of its other columns (rows alike in that are alike)."""
    prints, named = _classes(docs, shingle, radius)
    named = materialize(named, "classes")
    # the smallest row of each fingerprint first, so that a class is never gathered
    rank = lambda d, t: F.struct(F.col(d).isNull().alias("n"), F.col(d).alias("d"), F.coalesce(F.col(t), F.lit(0)).alias("t"))
    firsts = prints.groupBy("fp").agg(F.min(rank("doc_id", "th")).alias("r"))
    own_id, own_text = fresh(docs, "_id", "_text_hash")
    stays = firsts.join(named, F.col("fp") == F.col("cfp")).groupBy("root").agg(F.min("r").alias("r")).select(F.col("r.d").alias(own_id), F.col("r.t").alias(own_text))
    stays = materialize(stays.distinct(), "class-heads")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col(own_text))
    kept = docs.join(stays, same, "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not others:
        return kept.distinct()
    (row,) = fresh(docs, "_row")
    first = F.min_by(F.struct(*others), F.xxhash64(*others)).alias(row)
    return kept.groupBy("doc_id", "text").agg(first).select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))
