"""The pipeline on a small folder against a plain version of every stage."""

import hashlib
import random

import public_tokenizers
from test_operators import classes, plain_fingerprint, plain_lines
from tokenizers import Tokenizer

import corpus_pipeline
from patchloom.llm import toxicity


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    r = random.Random(9)
    vocab = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 9))) for _ in range(500)]
    bad = ["idiotic", "moronic", "scummy"]
    sentence = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item = sentence(30)
    rows = []
    for i in range(160):
        lines = [sentence(r.randint(8, 30)) for _ in range(r.randint(2, 5))]
        if i % 4 == 0:
            lines.insert(1, " ".join(x for w in sentence(12).split() for x in (w, r.choice(bad))))
        if i % 8 == 1:
            lines.append(item if i == 1 else item + " " + sentence(25))
        rows.append([i, "\n".join(lines)])
    rows += [[200, rows[5][1]], [201, rows[5][1]], [202, ""], [203, None]]
    docs = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)
    got = {(x.doc_id, x.n_tokens, tuple(x.ids), x.decoded_sha256) for x in corpus_pipeline.run(spark, folder).collect()}

    table = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    toxic = {x.doc_id for x in toxicity.toxicity(table("documents"), table("labels")).collect() if x.predicted}
    assert {i for i in range(160) if i % 4 == 0} == toxic
    left = [(i, t) for i, t in rows if i not in toxic]
    left = sorted(plain_lines(left).elements(), key=lambda x: x[0])
    roots = classes([plain_fingerprint(t) for _, t in left])
    first = {}
    for (i, _), root in zip(left, roots):
        first[root] = min(first.get(root, i), i)
    left = [(i, t) for (i, t), root in zip(left, roots) if first[root] == i]
    left = [(i, t) for i, t in left if item not in (t or "")]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    want = set()
    for i, t in left:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), tuple(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash", "decontamination", "bpe"]


def test_stages_keep_the_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_pipeline_on_odd_tables(spark, tmp_path):
    """An empty table; nulls, repeated rows and ids, and columns named like those the operators use inside."""
    names = ["label_id", "y", "fp", "root", "th", "words", "pos", "key", "reading", "_id", "_text_hash", "_row", "copies", "line_no", "score"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(1, "one lonely line of text about ships", "en", "s", 35), (1, "another text with the same id as the first", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, "a row without an id but with its own words", "en", "s", 1)]
    rows += [rows[0]] * 2 + [(5, "leaked words of the only item here today", "en", "s", 1)]
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "leaked words of the only item here today"), (None, None)], "item_id long, text string")
    for kind, own in (("full", [(*x, *names) for x in rows]), ("empty", [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{kind}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{kind}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{kind}/benchmark.parquet")
    got = sorted(((x.doc_id is None, x.doc_id or 0, x.n_tokens > 0) for x in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()))
    assert got == [(False, 1, True), (False, 1, True), (False, 2, False), (True, 0, True)]
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
