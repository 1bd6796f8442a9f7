"""Encoders: repairs and change sets to model-ready (input, output) rows.

Each strategy says how a hunk becomes a document, what the documents are compared with and how they are
ranked; the plan is common to all. Work is done at the grain where it repeats: a commit's hunks are
formatted once for each change set, then joined with the repairs of that commit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import code as C
from patchloom.functions import text as T
from patchloom.operators import metrics, preparation, ranking
from patchloom.storage import materialize

#: Markers of an encoded input.
CONTEXT, BREAK_START, BREAK_END, REPAIR_CONTEXT = "[<TESTCONTEXT>]", "[<BREAKAGE>]", "[</BREAKAGE>]", "[<REPAIRCONTEXT>]"
DELETED = "// Deleted"
EMPTY_LINES = "array<struct<line: string, type: string, lineNo: int>>"


@dataclass(frozen=True)
class Encoder:
    """A strategy: document form, ranking keys, whether context documents and edit sequences are used."""

    name: str
    word_level: bool = False
    edit_sequence: bool = False
    documents: bool = True
    by_similarity: bool = False

    def order(self) -> list[Column]:
        breakage = F.floor(F.col("tfidf_breakage") * 10 + 0.5)
        if self.by_similarity:
            return [-breakage, -F.col("repeat"), -F.floor(F.col("tfidf_testsrc") * 100 + 0.5), F.col("doc_no")]
        return [F.col("depth"), F.col("scope"), -breakage, F.col("doc_no")]


ENCODERS = {
    e.name: e
    for e in (
        Encoder("Base"), Encoder("SimOrder", by_similarity=True), Encoder("WordLevel", word_level=True, by_similarity=True),
        Encoder("EditSequence", word_level=True, edit_sequence=True, by_similarity=True), Encoder("NoContext", documents=False),
    )
}


def side(hunk: str, name: str) -> Column:
    return F.coalesce(F.col(f"{hunk}.{name}"), F.array().cast(EMPTY_LINES))


def code_of(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["line"]), " ")


def drop_comment_lines(repairs: DataFrame) -> DataFrame:
    """Comment lines leave the hunk; repairs whose hunk is empty or equal but for blanks go."""
    keep = lambda x: ~T.is_comment(x["line"])
    typed = repairs.withColumns({"source": F.filter(side("hunk", "sourceChanges"), keep), "target": F.filter(side("hunk", "targetChanges"), keep)})
    blank = lambda c: F.regexp_replace(code_of(F.col(c)), r"\s+", "")
    return typed.where((F.size("source") + F.size("target") > 0) & (blank("source") != blank("target")))


def in_range(repairs: DataFrame) -> DataFrame:
    """Repairs with source lines that all lie inside the test method."""
    numbers = F.transform("source", lambda x: x["lineNo"])
    start = F.col("bSource.startLine")
    last = start + F.size(F.split("bSource.code", "\n")) - 1
    return repairs.where(F.size("source") > 0).where(F.array_min(numbers).between(start, last) & F.array_max(numbers).between(start, last))


def test_context(repairs: DataFrame) -> Column:
    """The test's padded lines with markers around the broken ones; comment and blank lines go after marking."""
    numbers = F.transform("source", lambda x: x["lineNo"])
    low, high = F.array_min(numbers) - F.col("bSource.startLine"), F.array_max(numbers) - F.col("bSource.startLine")
    lines = F.split("padded_code", "\n")
    marked = F.transform(lines, lambda x, i: F.concat(F.when(i == low, F.lit(BREAK_START)).otherwise(""), x, F.when(i == high, F.lit(BREAK_END)).otherwise("")))
    kept = F.filter(marked, lambda x: (T.strip(x) != "") & ~T.is_comment(x))
    joined = F.replace(F.array_join(kept, " "), F.lit(f" {BREAK_START}"), F.lit(BREAK_START))
    return F.replace(joined, F.lit(f"{BREAK_END} "), F.lit(BREAK_END))


def hunk_documents(changes: DataFrame, encoder: Encoder, methods: DataFrame | None = None) -> DataFrame:
    """``project, aCommit, doc_no, document, name, path, scope`` of the non-test hunks that change more than blanks;
    ``doc_no`` is the place of the change and of the hunk in it.

    ``methods`` (project, aCommit, path, hunk, name, ord) tells which hunks are a method's: those are of scope 0 and
    carry its name, all others are their class's, of scope 1."""
    outer = changes.select("project", "aCommit", F.posexplode("changes").alias("c_no", "c")).where(~F.coalesce(F.col("c.is_test_source"), F.lit(False)))
    each = outer.select("project", "aCommit", "c_no", F.col("c.name").alias("class_name"), F.col("c.bPath").alias("path"), F.posexplode("c.hunks").alias("h_no", "hunk"))
    if methods is None:
        each = each.withColumns({"methodName": F.lit(None).cast("string"), "scope": F.lit("class")})
    else:
        each = preparation.label_hunks(each, methods)
    typed = each.withColumns({"source": F.transform(side("hunk", "sourceChanges"), lambda x: x["line"]), "target": F.transform(side("hunk", "targetChanges"), lambda x: x["line"])})
    typed = typed.where(~preparation.is_empty_hunk(F.col("hunk")))
    flat = typed.withColumns({"s": C.padded(F.array_join("source", " ")), "t": C.padded(F.array_join("target", " "))}).where(metrics.tokens(F.col("s")) != metrics.tokens(F.col("t")))
    if encoder.word_level:
        mark = lambda d: F.when(d["op"] == -1, F.concat(F.lit("[<DEL>]"), T.strip(d["text"]), F.lit("[</DEL>]"))).when(d["op"] == 1, F.concat(F.lit("[<ADD>]"), T.strip(d["text"]), F.lit("[</ADD>]"))).otherwise(T.strip(d["text"]))
        document = F.concat(F.lit("[<HUNK>]"), F.array_join(F.transform(C.diff_words("s", "t"), mark), ""), F.lit("[</HUNK>]"))
    else:
        document = T.base_document(F.when(F.col("s") != "", F.array("s")).otherwise(F.array().cast("array<string>")), F.when(F.col("t") != "", F.array("t")).otherwise(F.array().cast("array<string>")))
    method = F.col("scope") == "method"
    return flat.select("project", "aCommit", F.struct("c_no", "h_no").alias("doc_no"), document.alias("document"), F.when(method, F.col("methodName")).otherwise(F.col("class_name")).alias("name"), "path", F.when(method, 0).otherwise(1).alias("scope"))


def node_depths(graphs: DataFrame) -> DataFrame:
    """``bCommit, name_of_test, key, depth, most``: depth of the first node of each name and path, and the graph's greatest depth."""
    nodes = graphs.select(F.col("commit").alias("bCommit"), F.col("test").alias("name_of_test"), F.posexplode("value.nodes").alias("i", "n"))
    keyed = nodes.select("bCommit", "name_of_test", "i", F.explode(F.array("n.name", "n.path")).alias("key"), F.col("n.depth").alias("depth")).where("key IS NOT NULL")
    most = nodes.groupBy(F.col("bCommit").alias("gb"), F.col("name_of_test").alias("gt")).agg(F.max("n.depth").alias("most"))
    first = keyed.groupBy("bCommit", "name_of_test", "key").agg(F.min_by("depth", "i").alias("depth"))
    return first.join(most, (F.col("bCommit") == F.col("gb")) & (F.col("name_of_test") == F.col("gt"))).drop("gb", "gt")


def encode(repairs: DataFrame, changes: DataFrame, encoder: str = "SimOrder", budget: int = 512, graphs: DataFrame | None = None, methods: DataFrame | None = None, oversized: DataFrame | None = None) -> DataFrame:
    """``ID, project, aCommit, aCommitTime, trivial, input, output, n_documents, n_selected``.

    Repairs without change documents, with comment-only hunks or with lines outside their test are left
    out, and those that ``oversized`` (ID) lists. Documents are ranked by the strategy and taken while context and
    documents stay below ``budget``; a repair that takes none gets its first."""
    e = ENCODERS[encoder]
    rows = in_range(drop_comment_lines(preparation.without_ids(repairs, oversized)))
    rows = rows.withColumns({"broken": C.padded(code_of(F.col("source"))), "repaired": C.padded(code_of(F.col("target"))), "lines": F.split("bSource.code", "\n")})
    each = rows.select("ID", F.posexplode("lines").alias("i", "x")).withColumn("x", C.padded("x"))
    codes = each.groupBy("ID").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]), "\n").alias("padded_code"))
    rows = rows.join(codes, "ID").withColumn("context", test_context(rows))
    output = C.make_edit_sequence("broken", "repaired") if e.edit_sequence else F.when(F.col("repaired") == "", DELETED).otherwise(F.col("repaired"))
    rows = rows.select("ID", "project", "name", "bCommit", "aCommit", "aCommitTime", "trivial", "broken", "context", "padded_code", output.alias("output"))
    rows = materialize(rows, "encoded-rows")  # read four times below, and made by Arrow functions
    keys = ["ID", "project", "aCommit", "aCommitTime", "trivial"]
    if not e.documents:
        none = F.lit(0).cast("long")
        return rows.select(*keys, F.col("context").alias("input"), "output", none.alias("n_documents"), none.alias("n_selected"))
    docs = materialize(hunk_documents(changes, e, methods), "hunk-documents").withColumnsRenamed({"project": "_p", "aCommit": "_c", "name": "changed"})
    pairs = rows.select("ID", "project", "aCommit", "bCommit", "name").join(docs, (F.col("project") == F.col("_p")) & (F.col("aCommit") == F.col("_c")))
    first = F.struct("doc_no", "changed", "path", "scope")
    unique = pairs.groupBy("ID", "bCommit", "name", "document").agg(F.min(first).alias("d"), F.count("*").alias("repeat")).select("ID", "bCommit", F.col("name").alias("_test"), "document", "repeat", "d.*")
    if graphs is not None:
        depths = node_depths(graphs)
        most = depths.groupBy(F.col("bCommit").alias("_gb"), F.col("name_of_test").alias("_gt")).agg(F.max("most").alias("most"))
        depths = depths.select(F.col("bCommit").alias("_db"), F.col("name_of_test").alias("_dt"), "key", "depth")
        wanted = F.when(F.col("scope") == 0, F.col("changed")).otherwise(F.col("path"))
        unique = unique.join(depths, (F.col("bCommit") == F.col("_db")) & (F.col("_test") == F.col("_dt")) & (wanted == F.col("key")), "left")
        unique = unique.join(most, (F.col("bCommit") == F.col("_gb")) & (F.col("_test") == F.col("_gt")), "left").withColumn("depth", F.coalesce("depth", "most", F.lit(0)))
    else:
        unique = unique.withColumn("depth", F.lit(0))
    unique = materialize(unique, "documents")
    plain = unique.select("ID", "doc_no", metrics.tokens(F.col("document")).alias("words"))

    def similarity(goal: str, name: str) -> DataFrame:
        own = F.struct(F.lit(-1).alias("c_no"), F.lit(-1).alias("h_no"))
        target = rows.select("ID", own.alias("doc_no"), metrics.tokens(F.col(goal)).alias("words"))
        found = ranking.tfidf_cosine_of_words(plain.unionByName(target), "ID", "doc_no", own, "words")
        return materialize(found.withColumnRenamed("similarity", name), "similarities")  # its shuffle files go before the next is made

    scored = unique.join(similarity("broken", "tfidf_breakage"), ["ID", "doc_no"], "left").join(similarity("padded_code", "tfidf_testsrc"), ["ID", "doc_no"], "left").na.fill(0.0, ["tfidf_breakage", "tfidf_testsrc"])
    place = F.row_number().over(Window.partitionBy("ID").orderBy(*e.order()))
    lists = scored.withColumn("rank", place).groupBy("ID").agg(F.array_sort(F.collect_list(F.struct("rank", "document"))).alias("docs"))
    joined = rows.join(lists, "ID").withColumn("sizes", F.transform("docs", lambda d: F.size(metrics.tokens(d["document"]))))
    taken = ranking.greedy_select(F.col("sizes"), F.lit(budget - 2) - F.size(metrics.tokens(F.col("context"))))
    joined = joined.withColumn("taken", taken)
    chosen = F.when(F.size("taken") > 0, F.transform("taken", lambda i: F.get("docs", i)["document"])).otherwise(F.array(F.get("docs", F.lit(0))["document"]))
    text = F.concat(F.lit(CONTEXT), F.col("context"), F.lit(REPAIR_CONTEXT), F.array_join(chosen, ""))
    return joined.select(*keys, text.alias("input"), "output", F.size("docs").cast("long").alias("n_documents"), F.size("taken").cast("long").alias("n_selected"))


def split_encoded(encoded: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Adds ``split``; trivial repairs join train only if they are not newer than their project's last train row."""
    plain = ranking.temporal_split(encoded.where("trivial IS NULL"), "project", "aCommitTime", "aCommit", "ID", ratio)
    easy = ranking.merge_not_newer(encoded.where("trivial IS NOT NULL"), plain.where("split = 'train'"), "project", "aCommitTime")
    return plain.unionByName(easy.withColumn("split", F.lit("train")))


def trivial_types(repairs: DataFrame, renames: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``ID, trivial``: types of renames whose old name the test used before and whose new name it uses after.

    ``renames`` (commit, refactoringType, originalName, newName); ``before`` and ``after`` (commit, test, element)."""
    own = repairs.select("ID", "name", "bCommit", "aCommit")
    named = own.join(renames, F.col("aCommit") == F.col("commit")).drop("commit")
    used = lambda t, c, n, x: t.select(F.col("commit").alias(c), F.col("test").alias(n), F.col("element").alias(x)).distinct()
    hit = named.join(used(before, "_c", "_n", "_e"), (F.col("bCommit") == F.col("_c")) & (F.col("name") == F.col("_n")) & (F.col("originalName") == F.col("_e")), "left_semi")
    hit = hit.join(used(after, "_c", "_n", "_e"), (F.col("aCommit") == F.col("_c")) & (F.col("name") == F.col("_n")) & (F.col("newName") == F.col("_e")), "left_semi")
    return hit.groupBy("ID").agg(F.array_sort(F.collect_set("refactoringType")).alias("trivial"))
