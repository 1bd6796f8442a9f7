"""Fill-in-the-middle, shards and Merkle manifests: brute force, defined cases, repeats, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchloom.llm import fill_in_middle, merkle, sharding

NAMES = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, g string, place int, digest string, copies int, n string, form int, h0 string, k string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in any column, empty and odd texts, copies, repeated rows, a long text, markers, clashing columns."""
    r = random.Random(11)
    pool = ["a", "bc", "Word", " ", "\n", "é", "漢", "😀", "9", "_", "́", "@", "[", "`", "{", "\x00"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(70)]
    texts += ["", None, "\n", "x", "<P>", "a<S>b", "<M", "abc " * 5000, "q" * 20_000, "😀" * 9000, texts[3], texts[3]]
    rows = [(i, t, "en" if i % 3 else None, ["s1", "s2", "é", "Z", ""][i % 5] if i % 7 else None, len(t or "") if i % 4 else None) for i, t in enumerate(texts)]
    rows += [rows[5]] * 2 + [(None, "no id\n", "en", "s1", 6), (None, "no id\n", "en", "s1", 6), (None, None, None, None, None), (5, "other text of five", "en", rows[5][3], 1), (-4, "minus", "en", "only", 5)]
    return spark.createDataFrame([(*x, 1, "s", "g", 2, "d", 3, "n", 4, "h", "k") for x in rows], NAMES).repartition(4)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def plain_fim(doc_id, text, seed="1"):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(tokens), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle(docs):
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored, r.output_sha256, r.restored_sha256) for r in fill_in_middle.fill_in_middle(docs, ("output", "restored", "output_sha256", "restored_sha256")).collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        n, form, p, m, out = plain_fim(r.doc_id, r.text)
        want[(r.doc_id, n, form, p, m, out, r.text or "", sha(out), sha(r.text or ""))] += 1
    assert got == want and {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_other_rates_and_seeds(docs):
    assert {r.form for r in fill_in_middle.fill_in_middle(docs, fim_percent=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle.fill_in_middle(docs, fim_percent=100, spm_percent=100).collect()} == {"plain", "spm"}
    one, two = ({r.doc_id: r.output for r in fill_in_middle.fill_in_middle(docs, seed=s).collect()} for s in (1, 2))
    assert one != two


@pytest.mark.parametrize("chunk,strip", [(1, 1), (2, 5), (7, 20), (64, 1 << 10)])
def test_chunks_of_any_size_give_the_same_cuts(chunk, strip):
    r = random.Random(chunk)
    texts = ["".join(r.choice("ab é漢😀9\n") for _ in range(r.randint(0, 40))) for _ in range(60)]
    data, offsets = fill_in_middle._texts(pa.array([None, *texts])[1:])
    chunks = fill_in_middle.Chunks(data, offsets, chunk, strip)
    tokens = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert chunks.counts().tolist() == [len(x) for x in tokens]
    for share in (0.0, 0.3, 1.0):
        ranks = np.array([int(share * len(x)) for x in tokens])
        heads = ["".join(x[:k]) for x, k in zip(tokens, ranks)]
        size, points = chunks.cuts(ranks)
        assert size.tolist() == [len(h.encode()) for h in heads] and points.tolist() == [len(h) for h in heads]


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    data, offsets = fill_in_middle._texts(pa.array(["ab 1" * 50_000]))
    chunks = fill_in_middle.Chunks(data, offsets)
    seen = []
    real = fill_in_middle.boundaries
    monkeypatch.setattr(fill_in_middle, "boundaries", lambda d, b, e, f: seen.append(e - b) or real(d, b, e, f))
    size, _ = chunks.cuts(np.array([60_001]))
    assert seen == [fill_in_middle.CHUNK] and size[0] == 80_002


def plain_best(key, weights):
    def offer(i):
        u = (int(hashlib.md5(f"{i}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return weights[i] / -np.log(u)

    return max(range(len(weights)), key=offer)


def test_shards(docs):
    rows = sharding.shard_slots(docs).collect()
    given = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in given:
        data, key = (r.text or "").encode(), "" if r.doc_id is None else r.doc_id
        want[(r.doc_id, len(data) + 1, zlib.crc32(data), "key", plain_best(key, [1.0] * 8), plain_best(key, [1.0] * 9))] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard_slots(docs.repartition(7, "text")).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert sharding.shard_slots(docs.limit(0)).count() == 0


def test_a_row_repeated_many_times_fills_several_runs(spark):
    hot = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).union(spark.range(50).select("id", F.lit(None).cast("string")))
    rows = sharding.shard_slots(hot).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 20_050 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_set_the_shares_and_growth_moves_only_into_the_new_shard(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"))
    shares = {r["shard"]: r["count"] for r in sharding.assign_shards(keys, weights=[1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert all(abs(shares[i] / 20_000 - w / 8) < 0.015 for i, w in enumerate([1.0, 2.0, 5.0]))
    grown = sharding.moved(keys, [1.0, 2.0, 5.0], [1.0, 2.0, 5.0, 2.0]).collect()
    assert {r.new_shard for r in grown} == {3} and abs(sum(r["rows"] for r in grown) / 20_000 - 0.2) < 0.015
    shrunk = sharding.moved(keys, [1.0, 2.0, 5.0, 2.0], [1.0, 2.0, 5.0]).collect()
    assert {r.old_shard for r in shrunk} == {3}
    heavier = sharding.moved(keys, [1.0, 1.0, 1.0], [1.0, 1.5, 1.0]).collect()
    assert {r.new_shard for r in heavier} == {1}
    with pytest.raises(ValueError):
        sharding.assign_shards(keys, weights=[1.0, 0.0])


def test_written_shards(docs, spark, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text", "shard"), str(tmp_path / "out"), weights=[1.0] * 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {p.name for p in (tmp_path / "out").glob("shard_=*")} == {f"shard_={i}" for i in range(4)}
    assert all(plain_best("" if r.doc_id is None else r.doc_id, [1.0] * 4) == r.shard_ for r in back.collect())


def tree(leaves):
    """(root, path of each leaf as (left digests, right digests))."""
    paths, place, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for path, i in zip(paths, range(len(leaves))):
            p = place[i]
            b = p - p % 3
            path.append(("".join(now[b:p]), "".join(now[p + 1 : b + 3])))
            place[i] = p // 3
        now = [sha("".join(now[i : i + 3])) for i in range(0, len(now), 3)]
    return now[0], paths


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        own = sha("".join(map(field, (doc_id, source, lang, n_chars, text))))
        cut = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 2 == 0
        found = sha("".join(map(field, (doc_id, source, lang, n_chars, text and text.replace("\n", ""))))) if cut else own
        groups[source].append((doc_id is not None, doc_id or 0, own, found, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, tops = tree([subs[s][0] for s in names])
    out = Counter()
    for s, top in zip(names, tops):
        for (_, _, own, found, doc_id), path in zip(sorted(groups[s], key=lambda x: x[:4]), subs[s][1]):
            now = found
            for x, y in path + top:
                now = sha(x + now + y)
            out[(doc_id, own, subs[s][0], root, sha("".join(x + y for x, y in path + top)), now, now == root)] += 1
    return out


def manifest_rows(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def given(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest(docs):
    got = manifest_rows(merkle.document_manifest(docs))
    assert got == plain_manifest(given(docs))
    assert {x[-1] for x in got} == {True, False}
    assert merkle.document_manifest(docs.limit(0)).count() == 0


def test_small_blocks_give_the_same_manifest(spark):
    """Blocks of 3 and 9 nodes need many layers; a repeated row fills several runs; one group has most rows, many have one."""
    rows = [(i, "big" if i % 2 else f"s{i}" if i % 6 else None, "en", i, f"text\n{i}" if i % 5 else None) for i in range(160)] + [(9, "big", "en", 9, "text\n9")] * 1300
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    want = plain_manifest(rows)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, merkle.leaf(*(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS)))
    for levels in (1, 2):
        assert manifest_rows(merkle.manifest(docs, "source", "doc_id", merkle.FIELDS, changed, "proof_sha256", levels=levels)) == want


def test_one_row_and_full_proofs(spark):
    one = spark.createDataFrame([(1, None, None, None, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.manifest(one, "source", "doc_id", merkle.FIELDS).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof == [] and row.verified
    many = spark.createDataFrame([(i, "s", None, None, "t") for i in range(5)], one.schema)
    for row in merkle.manifest(many, "source", "doc_id", merkle.FIELDS).collect():
        assert merkle.climb_path(row.leaf.encode(), [(x.left.encode(), x.right.encode()) for x in row.proof]).decode() == row.root
    binary = merkle.manifest(many, "source", "doc_id", merkle.FIELDS, fanout=2, levels=2)
    assert {(r.verified, len(r.proof)) for r in binary.collect()} == {(True, 3)}
