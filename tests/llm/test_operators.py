"""The ten operators on small tables: brute force, nulls, ties, repeats, clashing columns, empty tables."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from patchloom.llm import batches, bpe, decontaminate, exact_topk, line_dedup, quality, simhash, substring_dedup, toxicity, url_reputation, warc
from patchloom.llm.components import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WS = " \t\n\x0b\x0c\r"


def words(text):
    out = "".join(" " if c in WS else c for c in text or "")
    return [w for w in out.split(" ") if w]


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, a long text, nulls, ties and columns named like internal ones."""
    r = random.Random(5)
    vocab = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(400)]
    sentence = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, common = sentence(60), sentence(9)
    rows = []
    for i in range(60):
        lines = [sentence(r.randint(3, 30)) for _ in range(r.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(1, common)
        if i % 6 == 1:
            lines.append(passage)
        if i % 10 == 3:
            own = passage.split()
            own[7] = "changed"
            lines.append(" ".join(own))
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, rows[5][1] + " extra"), (103, ""), (104, None), (105, " \n\t "), (106, "one"), (107, "two words")]
    rows += [(108, " ".join(r.choice(vocab) for _ in range(30_000))), (109, "x " * 300), (None, rows[5][1]), (None, "lonely null id"), (110, "É ñ\u00a0ß 漢字 😀"), (110, "É ñ\u00a0ß 漢字 😀")]
    rows += [(111, passage + " first variant"), (111, "second variant " + passage)]
    clash = [(*row, 1, "k", 2, "w", 3, 4, "z", 5, 6) for row in rows]
    names = "doc_id long, text string, fp int, key string, doc int, words string, th int, pos int, label string, root int, n_words int"
    return spark.createDataFrame(clash, names).repartition(5)


def both(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_bpe_is_the_library(spark, docs):
    lib = Tokenizer.from_file(TOKENIZER)
    lib.no_truncation()
    lib.no_padding()
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in bpe.encode_documents(docs, TOKENIZER).collect())
    want = Counter()
    for i, text in both(docs):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want[(i, len(ids), tuple(ids), lib.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_bpe_odd_texts_and_round_trip():
    lib = Tokenizer.from_file(TOKENIZER)
    codec = bpe.WordBpe(bpe.read_tokenizer(TOKENIZER))
    r = random.Random(3)
    pool = list("aábcdeßİΣσςÅñ0123٣²½'’<>|!?. \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u200b\u0301\u2028漢か😀🏽ﬁǅ") + ["'s", "'ll", "<|startoftext|>", "<|endoftext|>", "</w>", "the", "ing", "!!!!"]
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 14)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    long = "a" * 20_000 + "!" * 3000
    assert codec.encode(long) == lib.encode(long, add_special_tokens=False).ids
    assert codec.text(codec.encode("some plain words , here")) == "some plain words , here"
    assert codec.merged_words > 0


def test_bpe_pieces_do_not_matter(spark):
    """Pieces of any size give the same, and the seam test agrees with merging each pair of tokens."""
    import numpy as np
    import pyarrow as pa

    codec = bpe.WordBpe(bpe.read_tokenizer(TOKENIZER))
    texts = [f"word{i} and other{i % 7} Ünder{i}." for i in range(2000)] + [None, ""]
    whole = codec.encode_batch(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [x for part in batches.pieces(batch, 0, 500) for x in codec.encode_batch(part.column(0).to_pylist())]
    assert got == whole and len(list(batches.pieces(batch, 0, 500))) > 50
    r = random.Random(1)
    plain = [t for t in codec.vocab if not t.endswith("</w>")]
    a, b = [r.choice(plain) for _ in range(3000)], [r.choice(list(codec.vocab)) for _ in range(3000)]
    alone = [[*x, *(y if not y.endswith("</w>") else [*y[:-5], y[-5:]])] for x, y in zip(a, b)]
    want = [codec.merge(s) == [x, y] for s, x, y in zip(alone, a, b)]
    ids = lambda ts: np.array([codec.vocab[t] for t in ts])
    assert codec.compatible(ids(a), ids(b)).tolist() == want and 100 < sum(want) < 2900


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, ""), (4, "http://b/ q\r\n", None), (5, "u", "x" * 200_000), (5, "u", "x" * 200_000), (None, "n", "<p>é</p>"), (None, "m", "alone")]
    pages = spark.createDataFrame([(*x, 9, "c") for x in rows], "page_id long, url string, html string, sha int, size string").repartition(3)
    index = warc.write_archives(pages, str(tmp_path / "arc"))
    got = warc.read_records(index, index.folder, with_payload=True).collect()
    top = {}
    for i, _, html in rows:
        k = html or ""
        top[k] = max(top.get(k, -1), -1 if i is None else i)
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        response = top[html or ""] == (-1 if i is None else i)
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top[html or ""])] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}[5] == b"x" * 200_000
    some = warc.read_records(index.where("page_id = 2"), index.folder).collect()
    assert [r.page_id for r in some] == [2]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def plain_fingerprint(text, k=3):
    own = [w.encode() for w in words("".join(c.lower() if c.isascii() else c for c in text or ""))]
    if not own:
        return 0
    k = min(k, len(own))
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[i : i + k]), 42) for i in range(len(own) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, near=lambda a, b: bin(a ^ b).count("1") <= 3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if near(prints[a], prints[b]):
                root[find(a)] = find(b)
    return [find(x) for x in range(len(prints))]


def test_simhash(spark, docs):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    rows = both(docs)
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = classes(prints)
    low = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            low[root] = min(low.get(root, i), i)
    assert got == Counter((i, f"{p:016x}", low.get(root)) for (i, _), p, root in zip(rows, prints, roots))
    kept = simhash.one_per_class(docs)
    assert kept.count() == len(set(roots)) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_per_class(docs.limit(0)).count() == 0


def test_simhash_hot_buckets_are_cut_and_lose_nothing(spark):
    r = random.Random(1)
    centre = r.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:
        x = r.choice(sorted(prints)[:50])
        for _ in range(r.randint(1, 5)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    prints |= {r.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    pairs = [(a % 2**64, b % 2**64) for a, b in simhash.links(frame, bucket_limit=8).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in pairs)
    at = {x: i for i, x in enumerate(prints)}
    linked = {frozenset((at[a], at[b])) for a, b in pairs}
    mine = classes(list(range(len(prints))), lambda a, b: frozenset((a, b)) in linked)
    want = classes(prints)
    group = lambda roots: {frozenset(i for i, x in enumerate(roots) if x == root) for root in set(roots)}
    assert group(mine) == group(want)


def test_covering_masks_cover():
    masks = simhash.covering_masks(3)
    r = random.Random(2)
    for _ in range(2000):
        diff = sum(1 << b for b in r.sample(range(64), 3))
        assert any(diff & m == 0 for m in masks)
    subs = simhash.block_masks((1 << 30) - 1, 6, 3)
    assert all(any(sum(1 << b for b in bits) & s == 0 for s in subs) for bits in (r.sample(range(30), 3) for _ in range(500)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 50), (60, 61), (61, 60), (-5, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: -5 for i in range(1, 41)}, 61: 60}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def leave(rows, window=13):
    low = {}
    for i, t in rows:
        own = words(t)
        for at in range(len(own) - window + 1) if i is not None else ():
            k = tuple(own[at : at + window])
            low[k] = min(low.get(k, i), i)
    out = []
    for i, t in rows:
        own, gone = words(t), set()
        for at in range(len(own) - window + 1) if i is not None else ():
            if low[tuple(own[at : at + window])] < i:
                gone |= set(range(at, at + window))
        out.append((i, len(own), len(gone), " ".join(w for n, w in enumerate(own) if n not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window", [13, 6])
def test_substring_dedup(spark, docs, window):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs, window).collect())
    assert got == leave(both(docs), window)
    assert sum(n[2] for n in got) > 0


def test_substring_dedup_empty(spark, docs):
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0
    got = substring_dedup.substring_dedup(docs.where("doc_id IN (103, 104, 106)"), digests=True).collect()
    assert {r.kept_sha256 for r in got} == {hashlib.sha256(x).hexdigest() for x in (b"", b"one")}


def plain_lines(rows, threshold=0.8):
    order = lambda i, n: (-(1 << 63) if i is None else i, n)
    lines = [(order(i, n), frozenset(words(line))) for i, t in rows if t is not None for n, line in enumerate(t.split("\n"))]
    first = {}
    for at, s in lines:
        if s:
            first[s] = min(first.get(s, at), at)
    by_word = defaultdict(set)
    for s in first:
        for w in s:
            by_word[w].add(s)
    cut = dict(first)
    for s in first:
        for o in set().union(*(by_word[w] for w in s)):
            if 5 * len(s & o) >= 4 * len(s | o):
                cut[s] = min(cut[s], first[o])
    out = Counter()
    for i, t in rows:
        if t is None:
            out[(i, None)] += 1
            continue
        out[(i, "\n".join(line for n, line in enumerate(t.split("\n")) if not words(line) or cut[frozenset(words(line))] >= order(i, n)))] += 1
    return out


@pytest.mark.parametrize(("hot", "crowd"), [(2000, 64), (1, 1), (3, 2)])
def test_line_dedup(spark, docs, hot, crowd):
    done = line_dedup.line_dedup(docs, hot=hot, crowd=crowd)
    assert done.columns == [*docs.columns, "_lines", "_removed"]
    assert Counter((r.doc_id, r.text) for r in done.collect()) == plain_lines(both(docs))


def test_line_dedup_near_lines(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:18] + ["x", "y"])), (3, " ".join(base[:17] + ["p", "q", "r"])), (4, " ".join(reversed(base))), (5, "a b c d e"), (6, "a b c d"), (7, "a b c"), (8, "")]
    got = Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_lines(rows)
    assert line_dedup.line_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_line_dedup_sizes(spark, threshold):
    """Similar lines of all sizes meet, those whose sizes are in neighbouring classes too."""
    rng = random.Random(7)
    sets = []
    for size in range(1, 61):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for cut, more in ((0, 0), (size // 5, 0), (size // 6, 0), (0, size // 4), (size // 10, size // 10), (size // 9, size // 8)):
            sets.append(frozenset(base[cut:] + [f"x{rng.randrange(400)}" for _ in range(more)]))
    rng.shuffle(sets)
    near = lambda x, y: round(100 * threshold) * len(x | y) <= 100 * len(x & y)
    kept = [i for i, s in enumerate(sets) if not any(near(s, o) for o in sets[:i])]
    rows = [(i, " ".join(sorted(s))) for i, s in enumerate(sets)]
    done = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), threshold)
    assert sorted(r.doc_id for r in done.where("_removed = 0").collect()) == kept and 60 <= len(kept) < 300


def test_line_dedup_reads_texts_twice(spark):
    """Once to make the word sets that all steps share, once to put the kept lines together."""
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    rows = [(i, f"a line of words that {i // 2} texts share\nand one of its own {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = line_dedup.line_dedup(docs.withColumn("text", F.udf(count, "string").asNondeterministic()("text"))).agg(F.sum("_removed")).first()
    assert done[0] >= 20 and seen.value <= 2 * len(rows)


def test_decontamination(spark, docs):
    rows = both(docs)
    item = next(t for i, t in rows if i == 111).split()
    text = "Anna buys 12 apples and 7 pears for Bob in Paris at 5 kg each so how many are there"
    items = [(1, " ".join(item[2:40])), (2, text), (3, "too short"), (4, None), (None, "a question without an id but with many plain words in it"), (5, "5 6 7 8 9 10 11 12")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, key int")
    other = text.replace("Anna", "Carla").replace("12", "99").replace("Paris", "Rome").replace("Bob", "Dora")
    twisted = "Anna buys 12 apples and 12 pears for Bob in Paris at 12 kg each so how many are there"
    more = spark.createDataFrame([(500, "x y. " + other), (501, "z. " + text), (502, "Anna sells pears"), (503, "and a question without an id but with many plain words in it too"), (504, twisted)], "doc_id long, text string")
    own = docs.select("doc_id", "text").unionByName(more)
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(own, bench).collect()}
    assert {(500, 2), (501, 2), (503, None), (504, 2), (111, 1)} <= got and not any(i in (103, 104, 105, 502) for i, _ in got)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = decontaminate.contamination(own, bench, broadcast_rows=0)
        assert {(r.doc_id, r.item_id) for r in shuffled.collect()} == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = decontaminate.keep_uncontaminated(own, bench)
    gone = {i for i, _ in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in both(own) if i not in gone)
    assert decontaminate.matches(own.limit(0), bench).count() == 0 and decontaminate.matches(own, bench.limit(0)).count() == 0


def test_decontamination_checks_slots(spark):
    """One value of the item must not stand for two in the document."""
    item = "take 3 of the red boxes then add 3 of the blue boxes and give 3 away"
    good, bad = item.replace("3", "8"), item.replace("add 3", "add 4").replace("give 3", "give 5")
    frame = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    got = decontaminate.matches(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]


def test_decontamination_opening_names(spark):
    """Names that open a sentence, a line or the text are slots as well."""
    item = "Anna buys 5 apples at the market. Anna gives 2 apples to her friend Bob. How many apples does Anna have left now?"
    other = item.replace("Anna", "Carla").replace("Bob", "Dora").replace("5", "9").replace("2", "4")
    twisted = other.replace("Carla gives", "Erna gives")
    rows = [(1, other), (2, "a line before\n" + other), (3, "He said: " + other), (4, item), (5, twisted), (6, "Carla sells 9 pears. Dora goes home. How is she now?")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_windows, r.n_matched) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4][0] == got[4][1]


def test_decontamination_numbers_equal_by_chance(spark):
    """Two equal numbers of an item may become two different ones; names may not, and nothing else may differ much."""
    item = "Tom has 5 apples and 5 pears in his bag so how many fruits does he carry home"
    rows = [(1, item.replace("5 apples", "7 apples").replace("5 pears", "9 pears")), (2, item.replace("5", "8")), (3, item.replace("apples and 5 pears in his bag", "plums or 9 nuts on her desk")), (4, "what is 3 plus 4"), (5, "what is 2 plus 2"), (6, "what was 3 plus 4")]
    bench = spark.createDataFrame([(1, item), (2, "what is 2 plus 2")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (5, 2)}


def test_decontamination_short_items(spark):
    """Items of fewer words than a window are one window; with few plain words they are whole texts or nothing."""
    bench = spark.createDataFrame([(1, "what is two plus"), (2, "two words"), (3, "one"), (4, ""), (5, "  "), (6, "the 5 of us")], "item_id long, text string")
    rows = [(1, "tell me what is two plus two please"), (2, "only two words here"), (3, " Two  words\n"), (4, "one"), (5, "one more"), (6, ""), (7, None), (8, "what is\ntwo plus"), (9, "see the 7 of us"), (10, "what is two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, bench).collect()}
    assert got == {(1, 1), (8, 1), (3, 2), (4, 3), (9, 6)}


def test_decontamination_sql_has_both_readings(spark):
    """The SQL on texts where the readings differ, numbers part and items are short."""
    import duckdb

    item = "Anna buys 5 apples at the market. Anna gives 5 apples to her friend Bob. How many apples does Anna have left now?"
    items = [(1, item), (2, "what is two plus"), (3, "Tom has 5 apples and 5 pears today"), (4, None), (5, "one")]
    rows = [(1, item.replace("Anna", "Carla").replace("gives 5", "gives 2")), (2, "Bob asks what is two plus now"), (3, "Eva has 3 apples and 4 pears today"), (4, "one"), (5, None), (6, item), (6, item + " x"), (7, "Anna has 5")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    got = sorted((r.doc_id, r.item_id, r.n_windows, r.n_matched) for r in decontaminate.matches(docs, bench).collect())
    assert got == sorted(con.execute("SELECT doc_id, item_id, n_windows, n_matched FROM (" + decontaminate.oracle() + ")").fetchall()) and len(got) == 5


def test_tables_may_have_the_operators_own_names(spark, docs):
    """Every column name that an operator uses inside may stand in the caller's table and keeps its values."""
    names = ["_doc", "_th", "_kept", "_left", "_lines", "_removed", "_id", "_text_hash", "_d", "_t", "_gone", "_bad_id", "_bad_th", "doc", "th", "line_no", "fp", "root"]
    only = ["red", "green", "blue", "grey", "pink", "gold"]
    rows = [(i, f"{only[i]} stands alone in this row\nshared line of words\n{i}") + tuple(f"{n}{i}" for n in names) for i in range(6)]
    own = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "grey stands alone in this row")], "item_id long, text string")
    done = line_dedup.line_dedup(own)
    assert done.columns == [*own.columns, "_lines_", "_removed_"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in done.collect() for n in names) and sum(r._removed_ for r in done.collect()) == 5
    for kept, left in ((simhash.one_per_class(own), 6), (decontaminate.keep_uncontaminated(own, bench), 5)):
        found = kept.collect()
        assert kept.columns == own.columns and len(found) == left and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)


def test_quality_network(spark):
    """Gradient against differences, long texts in runs against the whole, training passages spread over a text."""
    import numpy as np

    r = np.random.default_rng(3)
    net = quality.AttentionMil(5)
    bags = [quality.passages("some words, and 12 more! " * n) for n in (1, 60, 200)]
    x, bag, y = np.concatenate(bags).astype(float), np.repeat(np.arange(3), [len(b) for b in bags]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = net.forward(x, bag, 3)[-1]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    found = net.gradient(x, bag, y)
    for name, d in found.items():
        for _ in range(4):
            at = tuple(int(r.integers(n)) for n in net.p[name].shape)
            keep = net.p[name][at]
            net.p[name][at] = keep + 1e-5
            high = loss()
            net.p[name][at] = keep - 1e-5
            low = loss()
            net.p[name][at] = keep
            assert abs((high - low) / 2e-5 - d[at]) < 1e-6
    # a plain forward pass, one passage at a time
    sig, p = (lambda v: 1 / (1 + np.exp(-v))), net.p
    for b, got in zip(bags, net.forward(x, bag, 3)[-1]):
        hs = [np.tanh(row @ p["E"] + p["e"]) for row in b]
        weights = [np.exp((np.tanh(h @ p["V"]) * sig(h @ p["U"])) @ p["w"]) for h in hs]
        z = sum(w * h for w, h in zip(weights, hs)) / sum(weights)
        assert abs(sig(z @ p["c"] + p["b"][0]) - got) < 1e-9
    long = "".join(chr(97 + int(c)) for c in r.integers(0, 26, 700_000)) + " É ñ. " * 5000
    whole = net.forward(quality.passages(long).astype(float), np.zeros(len(quality.passages(long)), int), 1)[-1][0]
    assert abs(net.long_score(long.encode()) - whole) < 1e-6 and abs(net.scores(["a", long, None])[1] - whole) < 1e-6
    assert len(quality.spread_passages(long, 64)) == 64
    every = quality.features(long.encode())
    groups = np.arange(len(every)) * 7 // len(every)
    assert np.allclose(quality.spread_passages(long, 7), [every[groups == g].mean(axis=0) for g in range(7)], atol=1e-5)


def test_toxicity_model_is_recounted(spark):
    """Log-odds, chance law and score of a small table by plain counting."""
    import math
    import zlib

    import numpy as np

    r = random.Random(6)
    vocab = ["".join(r.choice("aeiouhmnst") for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(r.choice(vocab[:40] if i % 5 == 0 and r.random() < 0.4 else vocab) for _ in range(60))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    bucket = lambda w: zlib.crc32(w.encode()) % (1 << toxicity.WORD_BITS)
    corpus, toxic, clean = (np.zeros(1 << toxicity.WORD_BITS) for _ in range(3))
    for i, text in rows:
        for w in text.split():
            corpus[bucket(w)] += 1
        if fold(i):
            for b in {bucket(w) for w in text.split()}:
                (toxic if i % 5 == 0 else clean)[b] += 1
    total, prior = corpus.sum() + 0.5 * len(corpus), 2000.0
    for w in vocab[:30]:
        b = bucket(w)
        a = prior * (corpus[b] + 0.5) / total
        y, n = toxic[b] + a, clean[b] + a
        delta = math.log(y / (toxic.sum() + prior - y)) - math.log(n / (clean.sum() + prior - n))
        shrunk = math.copysign(max(abs(delta) - 0.5 * math.sqrt(1 / y + 1 / n), 0), delta)
        assert abs(model.words[b] - (min(max(shrunk, -2), 4) / 2 - 0.3)) < 1e-9

    def best(text):
        codes = toxicity.text_codes(__import__("pyarrow").array([text]))[0]
        return [s for s, *_ in toxicity.segments(model.token_scores(codes))], len(codes)

    quiet = [best(t) for i, t in rows if fold(i) and i % 5]
    tops, sizes = np.array([max(s, default=0.0) for s, _ in quiet]), np.array([float(n) for _, n in quiet])

    def likelihood(rate):  # of the best segments under P(best <= x) = exp(-size * n * exp(-rate * x))
        size = len(tops) / (sizes * np.exp(-rate * tops)).sum()
        return (np.log(size * sizes * rate) - rate * tops - size * sizes * np.exp(-rate * tops)).sum()

    assert all(likelihood(model.rate) >= likelihood(x) - 1e-6 for x in (model.rate * 0.9, model.rate * 1.1) if 0.05 <= x <= 5)  # the fit's range
    assert abs(model.size - len(tops) / (sizes * np.exp(-model.rate * tops)).sum()) < 1e-6
    for x in toxicity.toxicity(frame, labels).limit(20).collect():
        found, n = best(rows[x.doc_id][1])
        evidence = sum(e for s in found if (e := model.rate * s - math.log(max(model.size * n, 1) / model.chance)) > 0)
        assert abs(x.score - 1 / (1 + math.exp(-(model.slope * math.log1p(evidence) + model.base)))) < 1e-9


def test_url_hosts_with_ports_users_and_addresses(spark):
    rows = [("u@a.com.mx:8080", 1), ("10.0.0.1:80", 1), ("[::1]", 0), ("x.co.uk", 0), ("", None)]
    frame = spark.createDataFrame(rows, "host string, outcome int")
    names = {r.host: (r.d, r.s) for r in frame.select("host", *[c.alias(n) for c, n in zip(url_reputation._domain_suffix(frame.host, ("com.mx", "co.uk")), "ds")]).collect()}
    assert names["u@a.com.mx:8080"] == ("a.com.mx", "com.mx") and names["10.0.0.1:80"] == ("10.0.0.1", "10.0.0.1")
    assert names["[::1]"][0] == "[::1]" and names["x.co.uk"] == ("x.co.uk", "co.uk") and names[""] == ("", "")


def accuracy(found, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in found.collect() if r.held_out and r.doc_id in truth]
    ones = [p for p, t in held if t == 1]
    assert sum(ones) / len(ones) > 0.8  # recall of label 1
    return sum(p == t for p, t in held) / len(held)


def test_quality_held_out(spark):
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    documents, labels = table("documents").where("doc_id < 6000"), table("labels")
    found = quality.quality(documents, labels, limit=1500)
    assert accuracy(found, labels, "quality") > 0.93


def test_toxicity_held_out(spark):
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    found = toxicity.toxicity(table("documents").where("doc_id < 6000"), table("labels"))
    assert accuracy(found, table("labels"), "toxic") > 0.97


@pytest.mark.parametrize("score", [quality.quality, toxicity.toxicity])
def test_classifiers_odd_rows(spark, docs, score):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(60)] + [(None, 1, 1, "x"), (3, None, None, "x"), (3, 1, 1, "y"), (4, 7, 7, "z")], "doc_id long, quality int, toxic int, text string")
    got = score(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in both(docs))
    assert all(0 <= r.score <= 1 and (r.held_out is None) == (r.doc_id is None) for r in got)
    assert score(docs, labels.limit(0)).count() == len(got)
    assert score(docs.limit(0), labels).count() == 0


def test_segments_are_all_maximal():
    import numpy as np

    def plain(s, base=0):
        """Recursive definition: take the best segment (leftmost, shortest), then both sides."""
        best = None
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                x = sum(s[a:b])
                if x > 0 and (best is None or x > best[0]):
                    best = (x, a, b)
        if best is None:
            return []
        x, a, b = best
        return [*plain(s[:a], base), (x, base + a, base + b), *plain(s[b:], base + b)]

    r = random.Random(4)
    for _ in range(300):
        s = [r.choice([-7, -5, -3, -2, 1.5, 2.25, 4.125, 5.0625]) + r.random() / 1000 for _ in range(r.randint(0, 12))]
        got = sorted((round(x, 6), a, b) for x, a, b in toxicity.segments(np.array(s)))
        assert got == sorted((round(x, 6), a, b) for x, a, b in plain(s))


def test_topk(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], 1) for i in range(300)]
    rows[7] = (7, rows[8][1], 1)
    rows += [(400, None, 1), (450, [1.0, float("nan")] + [0.0] * 4, 1), (500, [float("inf")] * 6, 1), (550, [None] + [1.0] * 5, 1), (600, [1.0, 2.0], 1), (650, [3.0, 1.0], 1), (700, [1e38] * 3, 1), (750, [-1e38] * 3, 1), (None, [1.0] * 6, 1)]
    rows += [rows[3], rows[50]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector int")
    import math

    ok = [(i, tuple(math.floor(256 * x) for x in e)) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = Counter()
    for i, q in ok:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in ok if j != i and len(e) == len(q))[:5]
            want.update((i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(found))
    assert sum(x[0] == 50 for x in want.elements()) == 10
    for size in (32, 4096):
        got = Counter((x.query_id, x.rank, x.vec_id, x.score) for x in exact_topk.exact_topk(frame, shard_rows=size, block_rows=4).collect())
        assert got == want
    assert exact_topk.exact_topk(frame.limit(0)).count() == 0


def test_topk_visits_few_leaves(spark):
    """Far apart clusters: a query is routed to the leaves whose boxes can hold a better vector; equal vectors fill several shards."""
    r = random.Random(9)
    rows = []
    for c in range(16):
        centre = [r.gauss(0, 40) for _ in range(4)]
        rows += [(c * 100 + j, [x + r.gauss(0, 1) for x in centre]) for j in range(100)]
    rows += [(5000 + i, [0.5] * 4) for i in range(900)]
    index = exact_topk.TopkIndex(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=100)
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in index.search(every=20).collect()}
    whole = {i: [int(256 * x // 1) for x in e] for i, e in rows}
    for i in (0, 440, 1500, 5000):
        best = sorted((-sum(a * b for a, b in zip(whole[i], e)), j) for j, e in whole.items() if j != i)[:5]
        assert [got[i, n] for n in range(1, 6)] == [(j, -s) for s, j in best]
    leaves, asked = len(index.boxes[4][0]), sum(i % 20 == 0 for i, _ in rows)
    clustered = [x for x in index.others.collect() if x.vec_id < 5000]
    assert leaves >= 12 and index.first.count() == asked
    assert len(clustered) < 0.5 * (leaves - 1) * sum(i % 20 == 0 and i < 5000 for i, _ in rows)
    assert index.placed.select("subs").agg({"subs": "max"}).first()[0] >= 9


def test_url_filter_cases(spark):
    urls = [None, "", "no scheme", "HTTP://Example.NET/en/x?y#z", "http://a.example.net", "http://net/", "http://xnet/", "http://example.com/de/", "http://example.com/fr/", "http://q.example.com?x=/de/", "ftp://u@w.ORG/fr/a", "http://b.co.uk/1", "x://y://z/p#q"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h"), (None, urls[7], "h")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.url_filter(pages).collect()}
    assert got[0] == got[1] == got[2] and got[0][:3] == ("", "", None)
    assert got[3][:3] == ("example.net", "/en/x", "example.net/en/") and got[3][3] == "allow"
    assert got[4][:3] == ("a.example.net", "", None)
    assert got[5][2:] == ("net/", "block") and got[6][2] is None
    assert got[7][2:] == ("example.com/de/", "block") and got[9][:3] == ("q.example.com", "", None)
    assert got[10] == ("u@w.org", "/fr/a", "org/fr/", "allow") and got[12][:2] == ("y:", "//z/p")
    assert url_reputation.url_filter(pages.limit(0)).count() == 0


def test_host_reputation_shrinks(spark):
    rows = [("a.bad.com", 1)] * 40 + [("b.bad.com", 1)] * 3 + [("a.good.com", 0)] * 40 + [("b.good.com", 1)] + [("c.bad.com", None), ("c.good.com", None), ("mixed.org", 1), ("mixed.org", 0)]
    got = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, outcome int")).collect()}
    assert got["a.bad.com"].verdict == got["b.bad.com"].verdict == "block"
    assert got["a.good.com"].verdict == got["b.good.com"].verdict == "allow"
    assert got["c.bad.com"].bound > got["c.good.com"].bound
    none = url_reputation.host_reputation(spark.createDataFrame([("h.com", None)], "host string, outcome int")).collect()
    assert none[0].verdict == "allow"
