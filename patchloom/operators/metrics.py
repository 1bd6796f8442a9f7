"""N-gram and structure metrics: the BLEU family, tree and data-flow matches, exact match, as relational plans.

The word runs of a pair are counted inside its row, so they are never exchanged; trees and edges are joined by the pair's ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import ngrams as ngrams_of
from patchloom.operators.reports import share

#: The reserved words of Java.
JAVA_KEYWORDS = (
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default", "do", "double", "else",
    "enum", "extends", "final", "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int", "interface", "long", "native",
    "new", "package", "private", "protected", "public", "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this", "throw",
    "throws", "transient", "try", "void", "volatile", "while",
)
#: The reserved words of Python.
PYTHON_KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally",
    "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
)
#: Epsilon, alpha and k of the smoothing methods.
EPSILON, ALPHA, K = 0.1, 5, 5
SMALLEST = 2.2250738585072014e-308


def tokens(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, space-joined; none if there are fewer words."""
    last = F.size(words) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def padded(words: Column, n: int, left: str | None = None, right: str | None = None) -> Column:
    """``words`` with n - 1 marks before or after, where a mark is given."""
    marks = lambda mark: F.array_repeat(F.lit(mark), n - 1) if mark is not None else F.array().cast("array<string>")
    return F.concat(marks(left), words, marks(right))


def ngram_counts(df: DataFrame, ids: list[str], words: str, most: int = 4) -> DataFrame:
    """``ids, n, gram, cnt`` for n = 1..most."""
    sized = F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col(words), n).alias("grams")) for n in range(1, most + 1)])
    each = df.select(*ids, F.explode(sized).alias("s")).select(*ids, "s.n", F.explode("s.grams").alias("gram"))
    return each.groupBy(*ids, "n", "gram").agg(F.count("*").alias("cnt"))


def closest_length(lengths: Column, h: Column) -> Column:
    """Reference length nearest to h, the shorter in a tie."""
    return F.array_min(F.transform(lengths, lambda r: F.struct(F.abs(r - h).alias("d"), r.alias("r"))))["r"]


def brevity(reference: Column, hypothesis: Column) -> Column:
    long_enough = hypothesis > reference
    return F.when(long_enough, 1.0).when(hypothesis == 0, 0.0).otherwise(F.exp(1.0 - reference / F.greatest(hypothesis, F.lit(1))))


def pair_counts(pairs: DataFrame, ids: list[str], hyp: str, refs: Column, most: int = 4, keywords=()) -> DataFrame:
    """``ids, hlen, rlen, s``: lengths (of the nearest reference, 0 without one) and shared runs (:data:`ngrams.SHARED`) of every pair.

    ``refs`` is an array of word arrays. The runs are counted inside the pair's row: none is exchanged, sorted or spilled."""
    nearest = closest_length(F.transform(refs, F.size), F.size(hyp))
    return pairs.select(*ids, F.size(hyp).alias("hlen"), F.coalesce(nearest, F.lit(0)).alias("rlen"), ngrams_of.shared(F.col(hyp), refs, most, keywords).alias("s"))


def precision_parts(pairs: DataFrame, ids: list[str], hyp: str, refs: Column, most: int = 4) -> DataFrame:
    """``ids, hlen, rlen, num1.., den1..``: clipped matches and hypothesis grams (1 at least) of every pair, with lengths."""
    counts = [F.col("s.matched")[n - 1].alias(f"num{n}") for n in range(1, most + 1)] + [F.greatest(F.col("s.own")[n - 1], F.lit(1)).alias(f"den{n}") for n in range(1, most + 1)]
    return pair_counts(pairs, ids, hyp, refs, most).select(*ids, "hlen", "rlen", *counts)


def smoothed(method: int, most: int = 4) -> list[Column]:
    """The precisions of n = 1..most under smoothing ``method`` (0 to 7), from ``num``, ``den`` and ``hlen`` columns.

    Methods 5 and 7 also need ``num`` and ``den`` of the next n. A precision that stays 0 (methods 4 and 6 on one word or
    without a common pair of words) has no logarithm, so the score is null there."""
    num = [F.col(f"num{n}").cast("double") for n in range(1, most + 1)]
    den = [F.col(f"den{n}").cast("double") for n in range(1, most + 1)]
    plain = [a / b for a, b in zip(num, den, strict=True)]
    if method == 0:
        return [F.when(a == 0, SMALLEST).otherwise(p) for a, p in zip(num, plain, strict=True)]
    if method == 1:
        return [F.when(a == 0, EPSILON / b).otherwise(a / b) for a, b in zip(num, den, strict=True)]
    if method == 2:
        return [(a + 1) / (b + 1) for a, b in zip(num, den, strict=True)]
    if method == 3:
        out, zeros = [], F.lit(0)
        for a, b in zip(num, den, strict=True):
            zeros = zeros + F.when(a == 0, 1).otherwise(0)
            out.append(F.when(a == 0, 1 / (F.pow(F.lit(2.0), zeros) * b)).otherwise(a / b))
        return out
    if method in (4, 7):
        log = F.log(F.greatest(F.col("hlen"), F.lit(1)).cast("double"))
        four = [F.when((a == 0) & (F.col("hlen") > 1), (i + K / log) / b).otherwise(a / b) for i, (a, b) in enumerate(zip(num, den, strict=True))]
        if method == 4:
            return four
        plain = four
    if method in (5, 7):
        extra = F.col(f"num{most + 1}").cast("double") / F.col(f"den{most + 1}")
        out, before = [], plain[0] + 1
        for i in range(most):
            before = (before + plain[i] + (plain[i + 1] if i + 1 < most else extra)) / 3
            out.append(before)
        return out
    if method == 6:
        out = plain[:2]
        for i in range(2, most):
            prior = F.when(out[i - 2] == 0, 0.0).otherwise(out[i - 1] * out[i - 1] / F.when(out[i - 2] == 0, 1.0).otherwise(out[i - 2]))
            grams = F.greatest(F.col("hlen") - i, F.lit(0))
            out.append((num[i] + ALPHA * prior) / (grams + ALPHA))
        return out
    raise ValueError(f"no smoothing method {method}")


def bleu_of(method: int = 1, most: int = 4) -> Column:
    """BLEU from the columns of :func:`precision_parts`; 0 without a common word."""
    mean = None
    for p in smoothed(method, most):
        term = F.log(p) / most
        mean = term if mean is None else mean + term
    return F.when(F.col("num1") == 0, 0.0).otherwise(brevity(F.col("rlen"), F.col("hlen")) * F.exp(mean))


def sentence_bleu(pairs: DataFrame, ids: list[str], hyp: str, ref: str, most: int = 4, method: int = 1) -> DataFrame:
    """``ids, bleu`` of each pair of word arrays."""
    more = 1 if method in (5, 7) else 0
    parts = precision_parts(pairs, ids, hyp, F.array(ref), most + more)
    return parts.select(*ids, bleu_of(method, most).alias("bleu"))


def corpus_parts(pairs: DataFrame, ids: list[str], hyp: str, refs: Column, most: int = 4) -> DataFrame:
    """One row: numerators, denominators (1 at least for each pair) and lengths summed over all pairs."""
    parts = precision_parts(pairs, ids, hyp, refs, most)
    names = [f"{c}{n}" for n in range(1, most + 1) for c in ("num", "den")]
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hlen", "rlen", *names)])


def corpus_bleu(pairs: DataFrame, ids: list[str], hyp: str, ref: str, most: int = 4, method: int = 1) -> DataFrame:
    """One row ``bleu``: numerators, denominators and lengths are summed over all pairs before the score."""
    return corpus_parts(pairs, ids, hyp, F.array(ref), most).select(bleu_of(method, most).alias("bleu"))


def _weighted_parts(other: float, most: int) -> list[tuple[Column, Column]]:
    """Recall numerators and denominators (1 at least) of n = 1..most; single words weigh 1 if they are keywords, else ``other``."""
    weigh = lambda keys, total: keys * 1.0 + (total - keys) * other
    single = weigh(F.col("s.key_matched"), F.col("s.matched")[0]), weigh(F.col("s.key_asked"), F.col("s.asked")[0])
    longer = [(F.col("s.matched")[n - 1].cast("double"), F.col("s.asked")[n - 1].cast("double")) for n in range(2, most + 1)]
    return [(num, F.greatest(den, F.lit(1.0))) for num, den in (single, *longer)]


def weighted_recall(pairs: DataFrame, ids: list[str], hyp: str, ref: str, keywords=JAVA_KEYWORDS, other: float = 0.2, most: int = 4) -> DataFrame:
    """``ids, n, num, den``: recall of reference grams; single words weigh 1 if they are keywords, else ``other``.

    A pair without reference grams of size n has no row of it."""
    counted = pair_counts(pairs, ids, hyp, F.array(ref), most, keywords)
    sizes = [F.struct(F.lit(n).alias("n"), num.alias("num"), den.alias("den"), F.col("s.asked")[n - 1].alias("asked")) for n, (num, den) in enumerate(_weighted_parts(other, most), 1)]
    return counted.select(*ids, F.explode(F.array(*sizes)).alias("x")).where("x.asked > 0").select(*ids, "x.n", "x.num", "x.den")


def corpus_scores(pairs: DataFrame, ids: list[str], hyp: str, ref: str, keywords=JAVA_KEYWORDS, other: float = 0.2, most: int = 4) -> DataFrame:
    """One row ``bleu, weighted, found, total`` from one pass over the pairs: corpus BLEU, its weighted variant (recalls summed over
    all pairs, a pair without grams of size n adds 1 to the sum below, each zero made ``EPSILON``), and of how many reference
    words (each as a tree of its own) the hypothesis has how many."""
    counted = pair_counts(pairs, ids, hyp, F.array(ref), most, keywords)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = [total(F.col("hlen")).alias("hlen"), total(F.col("rlen")).alias("rlen"), total(F.col("s.found")).alias("found"), total(F.col("s.asked")[0]).alias("total")]
    for n, (num, den) in enumerate(_weighted_parts(other, most), 1):
        sums += [total(F.col("s.matched")[n - 1]).alias(f"num{n}"), total(F.greatest(F.col("s.own")[n - 1], F.lit(1))).alias(f"den{n}"), total(num).alias(f"wnum{n}"), total(den).alias(f"wden{n}")]
    mean = None
    for n in range(1, most + 1):
        term = F.log(F.when(F.col(f"wnum{n}") == 0, EPSILON).otherwise(F.col(f"wnum{n}")) / F.greatest(F.col(f"wden{n}"), F.lit(1.0))) / most
        mean = term if mean is None else mean + term
    weighted = F.when(F.col("wnum1") == 0, 0.0).otherwise(brevity(F.col("rlen"), F.col("hlen")) * F.exp(mean))
    return counted.agg(*sums).select(bleu_of(1, most).alias("bleu"), weighted.alias("weighted"), "found", "total")


def weighted_corpus_bleu(pairs: DataFrame, ids: list[str], hyp: str, ref: str, keywords=JAVA_KEYWORDS, other: float = 0.2, most: int = 4) -> DataFrame:
    """One row ``bleu``: the weighted score of :func:`corpus_scores`."""
    return corpus_scores(pairs, ids, hyp, ref, keywords, other, most).select(F.col("weighted").alias("bleu"))


def tree_match(references: DataFrame, candidates: DataFrame, ids: list[str], tree: str) -> DataFrame:
    """``ids, matched, total``: subtrees (as text) of the references that the candidate has too; one may match many.

    Both sides have one row for each subtree. A reference without a tree has no row."""
    own = references.groupBy(*ids, tree).agg(F.count("*").alias("c"))
    seen = candidates.select(*ids, tree).distinct().withColumn("hit", F.lit(1))
    return own.join(seen, [*ids, tree], "left").groupBy(*ids).agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("c"))), F.lit(0)).alias("matched"), F.sum("c").alias("total"))


def merged_flow(edges: DataFrame, ids: list[str]) -> DataFrame:
    """One row for each variable occurrence: ``ids, pos, name, kind, sources`` (array of struct(pos, name)).

    ``edges`` has a row for each dependence (pos, name, kind, source_pos, source_name), sources null if there are none.
    Occurrences that neither depend on another nor feed one are left out; the kind of the first row stands."""
    source = F.when(F.col("source_pos").isNotNull(), F.struct(F.col("source_pos").alias("pos"), F.col("source_name").alias("name")))
    own = F.struct("pos", "name", "kind", source.alias("source"), F.lit(True).alias("own"))
    fed = F.when(F.col("source_pos").isNotNull(), F.struct(F.col("source_pos").alias("pos"), *[F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in ("name", "kind")], F.lit(None).alias("source"), F.lit(False).alias("own")))
    # a row at either end of a dependence: grouping finds what has one, and tables that are dealt by ``ids`` stay where they are
    ends = edges.select(*ids, F.explode(F.array_compact(F.array(own, fed))).alias("e")).select(*ids, "e.*").where("pos IS NOT NULL")
    flow = ends.groupBy(*ids, "pos").agg(F.min("name").alias("name"), F.min("kind").alias("kind"), F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or("own").alias("_own"), F.bool_and("own").alias("_ends"))
    return flow.where(F.col("_own") & (~F.col("_ends") | (F.size("sources") > 0))).drop("_own", "_ends")


def normal_flow(flow: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, edge``: every occurrence as text with its variables renamed in the order in which they are met.

    Rows are taken by position; a row's sources are met before its own variable."""
    rows = flow.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "kind", "sources"))).alias("rows"))
    met = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.concat(F.transform(r["sources"], lambda x: x["name"]), F.array(r["name"])))))
    called = lambda name: F.concat(F.lit("var_"), F.array_position(F.col("met"), name) - 1)
    text = lambda r: F.concat_ws(" ", called(r["name"]), r["kind"], F.array_join(F.transform(r["sources"], lambda x: called(x["name"])), " "))
    return rows.withColumn("met", met).select(*ids, F.explode(F.transform("rows", text)).alias("edge"))


def flow_match(references: DataFrame, candidates: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, matched, total`` over normal edges; every edge of the candidate is used once."""
    a = references.groupBy(*ids, "edge").agg(F.count("*").alias("a"))
    b = candidates.groupBy(*ids, "edge").agg(F.count("*").alias("b"))
    return a.join(b, [*ids, "edge"], "left").groupBy(*ids).agg(F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("matched"), F.sum("a").alias("total"))


def code_bleu(bleu: Column, weighted: Column, syntax: Column, flow: Column, weights: tuple = (0.25, 0.25, 0.25, 0.25)) -> Column:
    """The weighted sum of the four scores."""
    return weights[0] * bleu + weights[1] * weighted + weights[2] * syntax + weights[3] * flow


def match_rate(matched: Column, total: Column) -> Column:
    """matched / total, 0 if there is nothing to match."""
    return F.when(total == 0, 0.0).otherwise(matched / F.greatest(total, F.lit(1)))


def exact_match(predictions: DataFrame) -> DataFrame:
    """``ID, hit, best``: whether any prediction equals the target; best is that one, else the first."""
    hit = F.array_contains("preds", F.col("target"))
    return predictions.select("ID", F.coalesce(hit, F.lit(False)).alias("hit"), F.when(hit, F.col("target")).otherwise(F.get("preds", F.lit(0))).alias("best"))


def exact_match_rate(predictions: DataFrame) -> DataFrame:
    """One row ``n_ids, n_exact, rate``: rows with an exact prediction against distinct ids, in percent with two digits."""
    total = exact_match(predictions).agg(F.countDistinct("ID").alias("n_ids"), F.coalesce(F.sum(F.col("hit").cast("int")), F.lit(0)).alias("n_exact"))
    return total.withColumn("rate", F.when(F.col("n_ids") == 0, -1.0).otherwise(share(F.col("n_exact"), F.greatest("n_ids", F.lit(1)), 2)))
