"""A Merkle manifest of a dataset: one tree per group over its rows, one tree over the groups, a proof per row.

Leaves are hashed beside their rows (JVM functions); the texts go no further. Equal rows are counted before they
are ordered, rows are dealt by ranges of (group, order), and each range adds the counts of those before it, so a
group with most of the rows is spread over many tasks and every leaf knows its place in its group.

Places fall into aligned blocks of ``fanout ** levels`` nodes. A task holds one block as a contiguous numpy matrix
of 64 hex bytes a node: a reshape by the fanout gives the runs, each row of the reshaped matrix is hashed, level by
level, and the block's top is a node of the next layer, until a group has one node. Going down again each block
gets the sibling path of its top (a cogroup with one row a block) and finds the siblings of all its nodes by index
arithmetic: place p of a level lies in the run from p - p % fanout, and what lies in the run before and after it is
two slices of the level's matrix. A task never holds more than a block and its path.

Defined cases: nulls are ``-`` in a leaf, so they differ from empty texts; a null group comes first, as a group of its
own; a null order key comes first; rows with equal order keys are ordered by their leaves, and equal rows, being alike, take
neighbouring places; a group of one row has its leaf as subroot; a table of one group has its subroot as root; an
empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.sharding import crc32_of, crc32_sql
from patchloom.storage import materialize

FANOUT = 3
#: Levels that one block folds: 729 nodes.
LEVELS = 6
#: Copies of a row that are placed together at most.
COPIES = 512
HEX = 64


def leaf(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields one after another: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def _sha(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Block:
    """The levels of one aligned block: a matrix of hex digests each, the last one the block's top.

    ``alone``: the block is its group's only one, so folding ends at a single node; else it goes on for ``levels``."""

    def __init__(self, digests: pa.Array, alone: bool, fanout: int = FANOUT, levels: int = LEVELS):
        self.fanout, self.rows = fanout, [self.matrix(digests)]
        for _ in range(levels):
            if alone and len(self.rows[-1]) == 1:
                break
            self.rows.append(self.fold(self.rows[-1]))

    @staticmethod
    def matrix(digests: pa.Array) -> np.ndarray:
        return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, HEX)

    def fold(self, nodes: np.ndarray) -> np.ndarray:
        full = len(nodes) // self.fanout
        runs = nodes[: full * self.fanout].reshape(full, self.fanout * HEX)
        tops = [_sha(run.tobytes()) for run in runs]
        if len(nodes) > full * self.fanout:
            tops.append(_sha(nodes[full * self.fanout :].tobytes()))
        return np.frombuffer(b"".join(tops), np.uint8).reshape(-1, HEX)

    @property
    def top(self) -> str:
        return self.rows[-1].tobytes().decode()

    def siblings(self) -> list[list[tuple[bytes, bytes]]]:
        """For each node of the lowest level its path: (digests left of it in its run, digests right of it), level by level."""
        place, out = np.arange(len(self.rows[0])), [[] for _ in self.rows[0]]
        for nodes in self.rows[:-1]:
            data = nodes.tobytes()
            begin = place - place % self.fanout
            end = np.minimum(begin + self.fanout, len(nodes))
            for path, b, p, e in zip(out, (begin * HEX).tolist(), (place * HEX).tolist(), (end * HEX).tolist(), strict=True):
                path.append((data[b:p], data[p + HEX : e]))
            place = place // self.fanout
        return out


def climb_path(digest: bytes, path) -> bytes:
    for left, right in path:
        digest = _sha(left, digest, right)
    return digest


def _placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` (``g``, ``copies``, others) with ``start``, the place of the first copy in its group, and ``n``, the group's copies.

    A range's rows carry a running count; only one count for each group of a range is added up between ranges."""
    names = rows.columns
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("part", F.spark_partition_id())

    def run(batches):
        seen = 0
        for batch in batches:
            copies = batch.column(names.index("copies")).to_numpy(zero_copy_only=False)
            ends = seen + np.cumsum(copies)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - copies, pa.int64())], names=[*names, "part", "run"])
            seen = int(ends[-1]) if len(ends) else seen

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    counted = materialize(dealt.mapInArrow(run, f"{kinds}, run long"), label)
    sums = counted.groupBy(F.col("g").alias("pg"), F.col("part").alias("pp")).agg(F.sum("copies").alias("c"), F.min("run").alias("low"))
    before = Window.partitionBy("pg").orderBy("pp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("pg", "pp", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("c").over(Window.partitionBy("pg")).alias("n"))
    joined = counted.join(offsets, (F.col("g") == F.col("pg")) & (F.col("part") == F.col("pp")))
    return joined.withColumn("start", F.col("run") + F.col("shift")).drop("part", "run", "pg", "pp", "shift")


def _layer(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {width}"))


def _tops(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The next layer: a node for each block of ``nodes`` (``g, place, n, digest``)."""
    width = fanout**levels

    def run(key, table):
        table = table.sort_by("place")
        n = table.column("n")[0].as_py()
        block = Block(table.column("digest"), n <= width, fanout, levels)
        return pa.table([[key[0].as_py()], [key[1].as_py()], [-(-n // width)], [block.top]], names=["g", "place", "n", "digest"])

    return _layer(nodes, width).select("g", "block", "place", "n", "digest").groupBy("g", "block").applyInArrow(run, "g string, place long, n long, digest string")


def _layers(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """``nodes`` and the layers above it, up to one node for each group."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(materialize(_tops(out[-1], fanout, levels), "merkle-layer"))
    return out


PATHS = "g string, place long, lefts array<string>, rights array<string>"


def _paths(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The path of every node of a layer, its own siblings first: ``g, place, lefts, rights``."""
    width = fanout**levels

    def run(key, table, upper):
        table = table.sort_by("place")
        block = Block(table.column("digest"), table.column("n")[0].as_py() <= width, fanout, levels)
        lefts, rights = upper.column("lefts")[0].as_py(), upper.column("rights")[0].as_py()
        own = block.siblings()
        out = [[[x[0].decode() for x in path] + lefts for path in own], [[x[1].decode() for x in path] + rights for path in own]]
        return pa.table([table.column("g"), table.column("place"), *(pa.array(x, pa.list_(pa.string())) for x in out)], names=["g", "place", "lefts", "rights"])

    own = _layer(nodes, width).select("g", "block", "place", "n", "digest")
    return own.groupBy("g", "block").cogroup(above.groupBy("g", "place")).applyInArrow(run, PATHS)


def _down(layers: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Paths of the second layer's nodes (of the only one's, where there is one), from those of each group's top."""
    for nodes in reversed(layers[1:]):
        above = materialize(_paths(nodes, above, fanout, levels), "merkle-paths")
    return above


STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
PROOFS = {
    "proof_sha256": ("string", pa.string(), lambda path: hashlib.sha256(b"".join(x + y for x, y in path)).hexdigest()),
    "proof": ("array<struct<left: string, right: string>>", pa.list_(STEP), lambda path: [{"left": x.decode(), "right": y.decode()} for x, y in path]),
}


def manifest(docs: DataFrame, group: str, order: str, fields: list[str], changed: Column | None = None, proof: str = "proof", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row per row of ``docs``: ``order``, leaf, subroot, root, ``proof`` (one of :data:`PROOFS`), folded_root, verified.

    ``changed`` is a second leaf (null: none) that stands for a row as it is found now; it is folded with the siblings
    of the first, and ``verified`` says whether that gives the root."""
    width = fanout**levels
    own = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(order).cast("long").alias("k"), leaf(*(F.col(c) for c in fields)).alias("digest"), (F.lit(None) if changed is None else changed).cast("string").alias("found"))
    counted = own.groupBy("g", "k", "digest", "found").agg(F.count("*").alias("copies"))
    runs = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    runs = runs.withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("piece") * COPIES))
    placed = _placed(runs, ["k", "digest", "found", "piece"], "merkle-leaves")
    leaves = materialize(placed.withColumn("place", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("copies") - 1))).select("g", "place", "n", "digest", "found", "k"), "merkle-leaves")

    layers = _layers(leaves, fanout, levels)
    subroots = layers[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest", F.lit(1).cast("long").alias("copies"))
    groups = materialize(_placed(subroots, ["of"], "merkle-groups").select("g", F.col("start").alias("place"), "n", "digest", "of"), "merkle-groups")
    above = _layers(groups, fanout, levels)
    none = F.array().cast("array<string>")
    top = above[-1].select("g", "place", none.alias("lefts"), none.alias("rights"))
    ends = _paths(groups, _down(above, top, fanout, levels), fanout, levels) if len(above) > 1 else top
    named = groups.select("place", F.col("of"), F.col("digest").alias("subroot")).join(ends.select("place", "lefts", "rights"), "place")
    group_paths = materialize(named.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("place"), "lefts", "rights"), "merkle-paths")
    subs = groups.select(F.col("of").alias("sg"), F.col("digest").alias("subroot"))

    block_paths = _down(layers, group_paths, fanout, levels).join(subs, F.col("g") == F.col("sg")).select("g", "place", "lefts", "rights", "subroot")
    root = above[-1].first()
    block_paths = block_paths.withColumn("root", F.lit(root and root["digest"]))
    kind, arrow, make = PROOFS[proof]

    def run(key, table, upper):
        table = table.sort_by("place")
        block = Block(table.column("digest"), table.column("n")[0].as_py() <= width, fanout, levels)
        path_above = [(x.encode(), y.encode()) for x, y in zip(upper.column("lefts")[0].as_py(), upper.column("rights")[0].as_py(), strict=True)]
        root, subroot, tops, folded, proofs = upper.column("root")[0].as_py(), upper.column("subroot")[0].as_py(), {}, [], []
        for digest, found, path in zip(table.column("digest").to_pylist(), table.column("found").to_pylist(), block.siblings(), strict=True):
            proofs.append(make(path + path_above))
            top = climb_path((found or digest).encode(), path)
            if top not in tops:
                tops[top] = climb_path(top, path_above).decode()
            folded.append(tops[top])
        size = len(folded)
        columns = [table.column("k"), table.column("digest"), [subroot] * size, [root] * size, pa.array(proofs, arrow), folded, [x == root for x in folded]]
        return pa.table(columns, names=[order, "leaf", "subroot", "root", proof, "folded_root", "verified"])

    schema = f"`{order}` long, leaf string, subroot string, root string, {proof} {kind}, folded_root string, verified boolean"
    return _layer(leaves, width).groupBy("g", "block").cogroup(block_paths.groupBy("g", "place")).applyInArrow(run, schema)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by source; where 2 divides the CRC-32 of the decimal doc_id (null: of nothing) the row
    found now lacks its text's line feeds."""
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    changed = leaf(*(F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS))
    return manifest(docs, "source", "doc_id", FIELDS, F.when(tampered, changed), "proof_sha256")


def oracle() -> str:
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    text = lambda t: f"sha256({' || '.join(map(part, FIELDS[:-1]))} || {part(t)})"
    climb = lambda name, start: f"""{name} AS ({start}
  UNION ALL SELECT g, level + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, level, p // 3)"""  # noqa: E731
    return f"""
WITH RECURSIVE {crc32_sql()},
hashed AS (SELECT doc_id, source, {text("text")} AS leaf, CASE WHEN {crc32_of("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN {text("replace(text, chr(10), '')")} END AS found FROM documents, crc_table),
leaves AS (SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM hashed),
{climb("tree", "SELECT g, 0 AS level, p, leaf AS h, n FROM leaves")},
subroots AS (SELECT g AS s, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM tree WHERE n = 1),
{climb("crown", "SELECT '' AS g, 0 AS level, p, subroot AS h, n FROM subroots")},
lower AS (SELECT l.g, l.p AS leaf_p, t.level, string_agg(t.h, '' ORDER BY t.p) FILTER (t.p < l.p // (3 ** t.level)::BIGINT) AS lefts, string_agg(t.h, '' ORDER BY t.p) FILTER (t.p > l.p // (3 ** t.level)::BIGINT) AS rights
  FROM leaves l JOIN tree t ON t.g = l.g AND t.n > 1 AND t.p // 3 = (l.p // (3 ** t.level)::BIGINT) // 3 GROUP BY ALL),
upper AS (SELECT s.s AS g, t.level, string_agg(t.h, '' ORDER BY t.p) FILTER (t.p < s.p // (3 ** t.level)::BIGINT) AS lefts, string_agg(t.h, '' ORDER BY t.p) FILTER (t.p > s.p // (3 ** t.level)::BIGINT) AS rights
  FROM subroots s JOIN crown t ON t.n > 1 AND t.p // 3 = (s.p // (3 ** t.level)::BIGINT) // 3 GROUP BY ALL),
steps AS (SELECT g, leaf_p, level AS o, coalesce(lefts, '') AS x, coalesce(rights, '') AS y FROM lower
  UNION ALL SELECT l.g, l.p, 1000 + level, coalesce(lefts, ''), coalesce(rights, '') FROM leaves l JOIN upper u ON u.g = l.g),
proofs AS (SELECT g, leaf_p, list({{'x': x, 'y': y}} ORDER BY o) AS path FROM steps GROUP BY g, leaf_p),
folds AS (SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM crown WHERE n = 1) AS root, coalesce(q.path, []) AS path, coalesce(found, leaf) AS h FROM leaves l JOIN subroots s ON s.s = l.g LEFT JOIN proofs q ON q.g = l.g AND q.leaf_p = l.p),
done AS (SELECT *, list_reduce(list_prepend({{'x': h, 'y': ''}}, path), lambda a, b: {{'x': sha256(b.x || a.x || b.y), 'y': ''}}).x AS folded_root FROM folds)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda a: a.x || a.y), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done"""
