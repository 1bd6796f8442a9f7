"""Near-duplicate lines by an exact set-similarity join (DataFrame functions only).

A line is the set of its words ``[^\\x20\\x09-\\x0D]+``; lines are ordered by (doc_id, line number). A line
is removed if an earlier line has a Jaccard similarity of at least ``threshold`` with it, judged on the
input. Equal sets form one class that stands for all its lines; only the first lines of classes are joined:

* every text is cut once: the word sets of all lines are written as hashes, and counts, classes and verification
  read that table;
* words are ordered by rarity: a fixed-size table of counts over all lines, by hash bucket, gives each
  word a rank that is packed above its hash, so any two lines sort their shared words alike;
* prefix filter: similar sets of size s share a word among their first s - ceil(threshold * s) + 1, and l words
  among their first s - ceil(threshold * s) + l; a word that occurs in one line only is shared by nobody;
* length and positional filters bound the overlap that a shared prefix word still allows, and a parity
  bitmap of 64 or 128 bits bounds the difference of two sets from below; rows meet by prefix word and class of
  size, so that a word's list is not paired with itself in full;
* a word in more than ``crowd`` prefixes first offers its earliest line as a pivot to all its lines, which costs
  one row each; lines that a pivot settles ask no more, as one earlier match is enough;
* a key in more than ``hot`` prefixes is joined together with the next word of a prefix one longer, up to
  ``LEVELS`` words, so no pair is lost and long lists are cut;
* candidates are verified on the full word sets.

Words are compared by 56 bits of XXH64, classes by two XXH64 values of their sorted words.

Defined cases: a line without words is kept; null text stays null, empty text stays empty; a null doc_id
counts as the smallest; lines with the same doc_id and number (repeated rows) are not earlier than each
other; other columns of the rows are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.columns import fresh
from patchloom.storage import materialize, remove

BUCKETS = 1 << 21
BLANK = " \t\n\x0b\x0c\r"
#: White space inside a line, other than the space itself.
OTHER_BLANK = "\t\x0b\x0c\r"
#: Words of a joined key, at most.
LEVELS = 3
#: Lines of more words get a parity bitmap of 128 bits instead of 64.
LONG = 110
LOWEST = -(1 << 63)
HASH = (1 << 56) - 1
#: Bits of a table of flags.
FLAGS = 1 << 23
#: Rows of a table that may be broadcast.
FEW = 200_000
#: Parts of the join by single words.
ROUNDS = 2
#: Bytes of a file's dictionary of word hashes.
DICTIONARY = 1 << 24


def _spaced(text: Column) -> Column:
    """Other white space inside lines as spaces; most texts have none and pass as they are."""
    some = F.lit(False)
    for c in OTHER_BLANK:
        some = some | F.contains(text, F.lit(c))
    return F.when(some, F.translate(text, OTHER_BLANK, " " * len(OTHER_BLANK))).otherwise(text)


def _rank(count: float) -> int:
    return min(127, math.floor(4 * math.log2(count)))


def rarity_table(lines: DataFrame) -> DataFrame:
    """One row ``ranks``: a byte for each hash bucket, 4 * log2 of the lines that have its ``words`` (at most 127).

    The table has a fixed size, so it may travel through the driver; it only orders words, and any order
    gives the same result."""
    words = lines.select(F.explode("words").alias("h"))
    rank = F.least(F.lit(127), F.floor(4 * F.log2(F.count("*")))).cast("tinyint")
    counts = words.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(rank.alias("r"))
    written = materialize(counts, "word-counts")  # a write drops its shuffle files, an action does not
    counts = written.toArrow()
    remove(written)
    table = np.zeros(BUCKETS, np.int8)
    table[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    row = pa.ListArray.from_arrays(pa.array([0, BUCKETS], pa.int32()), pa.array(table))
    return materialize(lines.sparkSession.createDataFrame(pa.table({"ranks": row})), "word-ranks")


def _bucket(*key: str) -> Column:
    return F.xxhash64(*key).bitwiseAND(F.lit(FLAGS - 1)).cast("int")


def flag_table(buckets: DataFrame) -> DataFrame:
    """One row ``flags``: ``FLAGS`` bits in longs, 1 for those in ``buckets`` (one int column).

    Like the ranks it has a fixed size whatever the input, here 1 MB; a row whose bit is 0 is surely not in the set,
    and only the others need an exact join, so most rows are never exchanged."""
    at = F.col(buckets.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)))
    found = buckets.groupBy(F.shiftright(at, 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(FLAGS // 64, np.int64)
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    row = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table))
    return materialize(buckets.sparkSession.createDataFrame(pa.table({"flags": row})), "flags")


def _split(rows: DataFrame, flags: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that may be in the flagged set and those that are not."""
    told = rows.withColumn("_flags", flags.scalar())
    hit = F.getbit(F.get("_flags", F.shiftright(_bucket(*key), 6)), _bucket(*key).bitwiseAND(F.lit(63))) == 1
    return told.where(hit).drop("_flags"), told.where(~hit).drop("_flags")


def with_word_set(lines: DataFrame) -> DataFrame:
    """Adds ``words``: the hashes of the line's distinct words, sorted."""
    hashes = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    return lines.withColumn("words", F.sort_array(F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))))


def ranked(lines: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``order``: the ``words`` as sorted longs, rank above, 56 bits of hash below.

    The table is a scalar subquery; the optimizer moves it into the expression, rows never carry it. No element can
    be null, which the array's type has to say: such arrays are sorted as plain longs."""

    def pack(h: Column) -> Column:
        rank = F.coalesce(F.get(F.col("_ranks"), h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("tinyint")).cast("long")
        return F.shiftleft(rank, 56).bitwiseOR(h.bitwiseAND(F.lit(HASH)))

    return lines.withColumn("_ranks", table.scalar()).withColumn("order", F.sort_array(F.transform("words", pack))).drop("_ranks")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, text hash, line number, line) of every line that has a word; the line's white space is spaces."""
    own = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), _spaced(F.col("text")).alias("text"))
    return own.select("doc", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def _ratio(threshold: float) -> tuple[int, int]:
    part = Fraction(threshold).limit_denominator(100)
    return part.numerator, part.denominator


def _least_shared(size: Column, threshold: float) -> Column:
    a, b = _ratio(threshold)
    return F.floor((size * a + b - 1) / b).cast("int")


def _prefix(size: Column, threshold: float) -> Column:
    return size - _least_shared(size, threshold) + 1


def _parity(words: Column) -> tuple[Column, Column]:
    """A bitmap in which every word flips one bit, so two sets differ in no more bits than words.

    128 bits in two longs; for a short set both halves are folded into the first and the second is 0."""
    zero = F.lit(0).cast("long")
    flip = lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
    side = lambda n: F.aggregate(F.filter(words, lambda h: h.bitwiseAND(F.lit(64)) == n), zero, flip)
    long = F.size(words) > LONG
    return F.when(long, side(0)).otherwise(F.aggregate(words, zero, flip)), F.when(long, side(64)).otherwise(zero)


#: What a key's row carries: the class, packed numbers, bitmap. The numbers are the size, the position and the step
#: of the document on a scale of ``STEPS`` (an order of places that may tie), and whether the line still asks.
SLIM = ("c1", "packed", "sig", "sig2")
AT, SIZE, STEP, OPEN = 0, 22, 46, 1 << 60
STEPS = 1 << 14


def _field(side: str, shift: int, bits: int) -> Column:
    return F.shiftright(f"{side}.packed", shift).bitwiseAND(F.lit((1 << bits) - 1))


def _entries(heads: DataFrame, threshold: float, low: int, high: int) -> DataFrame:
    """The shared prefix words of every class head as ``k1``, with what :data:`SLIM` names and the place."""
    step = F.floor((F.col("doc").cast("double") - F.lit(float(low))) / F.lit(float(max(1, high - low))) * F.lit(STEPS - 1)).cast("long")
    open_ = F.when(F.col("open"), F.lit(OPEN)).otherwise(F.lit(0).cast("long"))
    own = heads.select("doc", "line_no", "c1", "size", "sig", "sig2", "prefix", "open", F.posexplode(F.slice("prefix", 1, _prefix(F.col("size"), threshold))).alias("at", "k1"))
    packed = open_.bitwiseOR(F.shiftleft(F.coalesce(step, F.lit(0)), STEP)).bitwiseOR(F.shiftleft(F.col("size").cast("long"), SIZE)).bitwiseOR(F.col("at").cast("long"))
    return own.where(F.col("k1") > HASH).withColumn("packed", packed)  # rank 0: one occurrence in all documents


def _alike(threshold: float, first: bool = False) -> Column:
    """Whether the sets of rows ``x`` and ``y`` of one key may be similar; ``first``: no earlier word is shared."""
    a, b = _ratio(threshold)
    size, pos = (lambda side: _field(side, SIZE, 24)), (lambda side: _field(side, AT, 22))
    length = (size("x") * b >= size("y") * a) & (size("y") * b >= size("x") * a)
    before = F.lit(0) if first else F.least(pos("x"), pos("y"))
    most = before + F.least(size("x") - pos("x"), size("y") - pos("y"))
    enough = most * (a + b) >= (size("x") + size("y")) * a
    one, two = F.col("x.sig").bitwiseXOR(F.col("y.sig")), F.col("x.sig2").bitwiseXOR(F.col("y.sig2"))
    folded = (F.col("x.sig2") == 0) | (F.col("y.sig2") == 0)
    bits = F.when(folded, F.bit_count(one.bitwiseXOR(two))).otherwise(F.bit_count(one) + F.bit_count(two))
    return (bits * (a + b) <= (size("x") + size("y")) * (b - a)) & length & enough


def _wanted() -> Column:
    """Whether the later line of ``x`` and ``y`` may still ask."""
    step = lambda side: _field(side, STEP, 14)
    asks = lambda side: F.col(f"{side}.packed") >= OPEN
    return (asks("y") & (step("x") <= step("y"))) | (asks("x") & (step("y") <= step("x")))


def _first_matches(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: pairs of classes whose first shared word is ``k1``, that the filters let pass and that may still ask.

    Sizes are classed so that similar sets are at most one class apart. At position p a set of size s still shares
    s - p words, so it can be the smaller of a pair (``x``) up to a ninth of s (threshold 0.8) and the larger
    (``y``) for sizes up to a bound; it stands in its own class as the one, in the classes of those sizes as the
    other. Rows are exchanged once, by word; that spreading happens behind the exchange. The lists have
    bounded length (see ``hot`` and ``crowd``) and are looked up in a hash table."""
    a, b = _ratio(threshold)
    own = rows.select("k1", *SLIM).repartition("k1")
    s, p = (F.shiftright("packed", SIZE).bitwiseAND(F.lit((1 << 24) - 1)), F.shiftright("packed", AT).bitwiseAND(F.lit((1 << 22) - 1)))
    of = lambda size: F.floor(F.log(size.cast("double")) / F.lit(math.log(1.0001 * b / a))).cast("int")
    left = (s - p) * (a + b)
    low, high = F.floor((s * a + b - 1) / b), F.least(s, F.floor(left / a) - s)
    smaller = F.when(left >= 2 * a * s, 2 * of(s) + 1)
    larger, next_larger = F.when(high >= low, 2 * of(high)), F.when((high >= low) & (of(high) > of(low)), 2 * of(low))
    spread = own.select("k1", *SLIM, F.explode(F.array(smaller, larger, next_larger)).alias("role")).where("role IS NOT NULL")
    spread = spread.select("k1", *SLIM, (F.col("role") % 2 == 1).alias("small"), F.shiftright("role", 1).alias("of"))
    x, y = spread.where("small").alias("x"), spread.where("NOT small").alias("y")
    size = lambda side: _field(side, SIZE, 24)
    once = (size("x") < size("y")) | ((size("x") == size("y")) & (F.col("x.c1") < F.col("y.c1")))
    found = y.join(x.hint("shuffle_hash"), (F.col("x.k1") == F.col("y.k1")) & (F.col("x.of") == F.col("y.of")) & once & _alike(threshold, True) & _wanted())
    return found.select(F.least("x.c1", "y.c1").alias("a"), F.greatest("x.c1", "y.c1").alias("b"))


def _matches(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """``a, b``: pairs of classes of equal ``keys`` that the filters let pass, once, if the later may still ask.

    Both sides are one exchange."""
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    rows = rows.select(*keys, *SLIM)
    found = rows.alias("x").join(rows.alias("y"), same & (F.col("x.c1") < F.col("y.c1")) & _alike(threshold) & _wanted())
    return found.select(F.col("x.c1").alias("a"), F.col("y.c1").alias("b"))


def _at(place: str) -> Column:
    return F.col("doc").eqNullSafe(F.col(f"{place}doc")) & (F.col("line_no") == F.col(f"{place}line")) & (F.col("c1") == F.col(f"{place}c1"))


def _verified(lines: DataFrame, heads: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``ldoc, lline, lc1``: the later classes of the pairs whose word sets are similar; a table.

    The word sets are taken from the lines whose place and class are flagged; a line that is flagged by chance matches
    no pair, or is a later copy of a class, whose place no class head has."""
    names = flag_table(pairs.select(F.explode(F.array(_bucket("a"), _bucket("b")))))
    maybe, _ = _split(heads.select("doc", "line_no", "c1"), names, "c1")
    places = flag_table(maybe.select(_bucket("doc", "line_no")))
    sets, _ = _split(lines.select("doc", "line_no", "c1", "words"), places, "doc", "line_no")
    sets, _ = _split(sets, names, "c1")
    sets = materialize(sets, "line-sets", dictionary=DICTIONARY)
    own = lambda s: sets.select(*[F.col(c).alias(f"{s}{c}") for c in ("doc", "line_no", "c1", "words")])
    a, b = _ratio(threshold)
    both = pairs.join(own("x"), F.col("a") == F.col("xc1")).join(own("y"), F.col("b") == F.col("yc1"))
    shared = F.size(F.array_intersect("ywords", "xwords"))
    similar = both.where(shared * (a + b) >= (F.size("ywords") + F.size("xwords")) * a)
    low = lambda s: F.coalesce(F.col(f"{s}doc"), F.lit(LOWEST))
    after = lambda s, o: (low(s) > low(o)) | (F.col(f"{s}doc").eqNullSafe(F.col(f"{o}doc")) & (F.col(f"{s}line_no") > F.col(f"{o}line_no")))
    pick = lambda s: F.struct(F.col(f"{s}doc").alias("ldoc"), F.col(f"{s}line_no").alias("lline"), F.col(f"{s}c1").alias("lc1"))
    later = similar.select(F.when(after("y", "x"), pick("y")).when(after("x", "y"), pick("x")).alias("l")).where("l IS NOT NULL").select("l.*")
    later = materialize(later.distinct(), "later-lines")
    remove(sets)
    return later


def _later_classes(lines: DataFrame, heads: DataFrame, threshold: float, hot: int, crowd: int, low: int, high: int) -> DataFrame:
    """``ldoc, lline, lc1`` of every class that an earlier class resembles."""
    entries = _entries(heads.withColumn("open", F.lit(True)), threshold, low, high)
    least = F.lit(_rank(crowd + 1) << 56)  # a word is in no more prefixes than lines have it
    common = entries.where(F.col("k1") >= least)
    pivot = F.min(F.struct(F.coalesce("doc", F.lit(LOWEST)).alias("low"), "line_no", *SLIM)).alias("x")
    words = materialize(common.groupBy("k1").agg(F.count("*").alias("n"), pivot).where(F.col("n") > crowd).select(F.col("k1").alias("w"), "n", "x"), "crowded-words")
    n_words = words.count()
    settled = None
    if n_words:
        offered = common.select("k1", F.struct(*SLIM).alias("y")).join(_small(words.select("w", "x"), n_words), F.col("k1") == F.col("w"))
        offered = offered.where((F.col("x.c1") != F.col("y.c1")) & _alike(threshold)).select(F.col("x.c1").alias("a"), F.col("y.c1").alias("b"))
        offered = materialize(offered.distinct(), "pivot-candidates")
        settled = _verified(lines, heads, offered, threshold)
        remove(offered)
        marked = _looked_up(heads, settled, settled.count(), _at("l"), "c1", "lc1").withColumn("open", F.col("lc1").isNull()).drop("ldoc", "lline", "lc1")
        entries = _entries(marked, threshold, low, high)
    busy = words.where(F.col("n") > hot).select(F.col("w").alias("h1"))
    rows, found, level = entries, [], 1
    while True:
        keys = [f"k{i}" for i in range(1, level + 1)]
        n_busy = busy.count() if n_words else 0
        if not n_busy or level == LEVELS:
            found += _found(rows, keys, threshold)
            break
        same = F.lit(True)
        for i in range(1, level + 1):
            same = same & (F.col(f"k{i}") == F.col(f"h{i}"))
        told = rows.join(_small(busy.withColumn("h0", F.lit(1)), n_busy), same, "left")
        # sets that may share no more words than the key has stay under it as well
        few = _least_shared(F.col("size"), threshold) <= level
        found += _found(told.where(F.col("h0").isNull() | few), keys, threshold)
        more = told.where("h0 IS NOT NULL").drop("h0", *[f"h{i}" for i in range(1, level + 1)])
        rest = F.slice("prefix", F.col("at") + 2, F.greatest(_prefix(F.col("size"), threshold) + level - F.col("at") - 1, F.lit(0)))
        ahead = more.select(*SLIM, "size", "prefix", F.col("at").alias("base"), *keys, F.posexplode(rest).alias("step", f"k{level + 1}"))
        rows = ahead.withColumn("at", F.col("base") + 1 + F.col("step")).drop("base", "step").where(F.col(f"k{level + 1}") > HASH)
        level += 1
        if level < LEVELS:
            counted = rows.groupBy(*[f"k{i}" for i in range(1, level + 1)]).agg(F.count("*").alias("n")).where(F.col("n") > hot)
            busy = materialize(counted.select(*[F.col(f"k{i}").alias(f"h{i}") for i in range(1, level + 1)]), "crowded-keys")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = materialize(pairs.distinct(), "line-candidates")
    remove(*found)
    later = _verified(lines, heads, pairs, threshold)
    remove(pairs, words)
    return later if settled is None else later.unionByName(settled).distinct()


def _found(rows: DataFrame, keys: list[str], threshold: float) -> list[DataFrame]:
    """Tables of the matches of ``rows``. Those by one word come in ``ROUNDS`` parts of the words, one after another,
    each of which drops its exchange: so much less of it is on disk at once."""
    if len(keys) > 1:
        return [materialize(_matches(rows, keys, threshold).distinct(), "line-pairs")]
    parts = [rows.where(F.pmod("k1", F.lit(ROUNDS)) == i) for i in range(ROUNDS)]
    with _by_some_keys(rows.sparkSession):
        return [materialize(_first_matches(part, threshold).distinct(), "line-pairs") for part in parts]


@contextmanager
def _by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Rows dealt out by the first of a join's keys are not dealt out again by all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _looked_up(rows: DataFrame, table: DataFrame, n: int, same: Column, name: str, found: str) -> DataFrame:
    """``rows`` left-joined with a table of ``n`` rows; of rows whose ``name`` is surely not in its ``found``, none is exchanged."""
    if n <= FEW:
        return rows.join(F.broadcast(table), same, "left")
    maybe, sure = _split(rows, flag_table(table.select(_bucket(found))), name)
    return maybe.join(table, same, "left").unionByName(sure, allowMissingColumns=True)


def _small(table: DataFrame, rows: int, most: int = FEW) -> DataFrame:
    """Broadcast only a table whose counted rows are few; any other is joined by a shuffle."""
    return F.broadcast(table) if rows <= most else table


def kept_lines(docs: DataFrame, threshold: float = 0.8, hot: int = 2000, crowd: int = 250) -> DataFrame:
    """``doc, th, kept``: for each document (id and text hash) the numbers of its lines with words that stay; a table."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    words, order = F.col("words"), F.col("order")
    lines = with_word_set(_lines(docs)).select("doc", "th", "line_no", F.xxhash64("words").alias("c1"), F.xxhash64(F.lit(1), "words").alias("c2"), F.size("words").alias("size"), "words")
    lines = materialize(lines, "lines", dictionary=DICTIONARY)
    table = rarity_table(lines)
    classes = lines.groupBy("c1", "c2").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1")
    classes = materialize(classes.select(F.col("c1").alias("m1"), F.col("c2").alias("m2"), F.col("first.doc").alias("mdoc"), F.col("first.line_no").alias("mline"), "n"), "line-classes")
    several, repeats = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    joined = _looked_up(lines, classes, several, (F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2")), "c1", "m1")
    first = joined.where(F.col("m1").isNull() | (F.col("doc").eqNullSafe(F.col("mdoc")) & (F.col("line_no") == F.col("mline"))))
    longest = _prefix(F.col("size"), threshold) + LEVELS - 1  # one more for each further word of a key
    parity = _parity(words)
    heads = ranked(first, table).select("doc", "th", "line_no", "c1", "c2", "size", parity[0].alias("sig"), parity[1].alias("sig2"), F.slice(order, 1, longest).alias("prefix"))
    heads, n_lines = materialize(heads, "line-heads"), lines.count()
    n_heads, low, high = heads.agg(F.count("*"), F.coalesce(F.min("doc"), F.lit(0)), F.coalesce(F.max("doc"), F.lit(0))).first()
    repeated = n_heads > n_lines - repeats + several  # rows of one doc_id that have the same line
    own = heads.dropDuplicates(["c1", "c2"]) if repeated else heads
    later = _later_classes(lines, own, threshold, hot, crowd, low, high)
    remove(lines)
    kept = heads.join(_small(later, later.count()), _at("l"), "left_anti")
    kept = materialize(kept.groupBy("doc", "th").agg(F.collect_set("line_no").alias("kept")), "kept-lines")
    remove(heads, classes)
    return kept


def line_dedup(docs: DataFrame, threshold: float = 0.8, hot: int = 2000, crowd: int = 250) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``, and the counts ``_lines`` and ``_removed`` added.

    A count whose name ``docs`` has already gets underscores at the end."""
    doc, th, own, cut, left, lines, removed = fresh(docs, "_doc", "_th", "_kept", "_cut", "_left", "_lines", "_removed")
    kept = kept_lines(docs, threshold, hot, crowd).withColumnsRenamed({"doc": doc, "th": th, "kept": own})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th))
    parts = F.col(cut)
    blank = F.array_compact(F.transform(parts, lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) == "", i)))
    stays = F.array_intersect(F.sequence(F.lit(0), F.size(parts) - 1), F.array_union(F.coalesce(own, F.array().cast("array<int>")), blank))
    joined = docs.join(kept, same, "left").withColumn(cut, F.split("text", "\n")).withColumn(left, stays)
    count = lambda c: F.coalesce(F.when(F.col("text").isNotNull(), c), F.lit(0)).cast("long")
    counted = joined.withColumns({lines: count(F.size(parts)), removed: count(F.size(parts) - F.size(left))})
    text = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    return counted.withColumn("text", F.when(F.col(removed) == 0, F.col("text")).otherwise(text)).select(*docs.columns, lines, removed)


def line_digests(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` for every row of ``docs``."""
    done = line_dedup(docs.select("doc_id", "text"), threshold)
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle(threshold: float = 0.8) -> str:
    a, b = _ratio(threshold)
    return f"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS s FROM l),
f AS (SELECT t, count(*) AS k FROM (SELECT unnest(s) AS t FROM w) GROUP BY t),
u AS (SELECT DISTINCT s FROM w WHERE len(s) > 0),
o AS (SELECT s, list(t ORDER BY k, t) AS q FROM (SELECT s, unnest(s) AS t FROM u) JOIN f USING (t) GROUP BY s),
c AS (SELECT w.s, any_value(q) AS q, len(w.s) AS n, min((doc_id, line_no)) AS first, row_number() OVER () AS c FROM w JOIN o ON w.s = o.s GROUP BY w.s),
p AS (SELECT c, n, first, s, unnest(list_slice(q, 1, n - CAST(ceil(n * {a} / {b}) AS INTEGER) + 1)) AS t FROM c),
later AS (SELECT DISTINCT y.c FROM p x JOIN p y ON x.t = y.t AND x.first < y.first AND x.n * {b} >= y.n * {a} AND y.n * {b} >= x.n * {a}
  WHERE len(list_intersect(x.s, y.s)) * {a + b} >= (x.n + y.n) * {a}),
kept AS (SELECT s, first FROM c WHERE c NOT IN (SELECT c FROM later)),
r AS (SELECT w.doc_id, list(w.line_no) AS gone FROM w LEFT JOIN kept k ON w.s = k.s AND k.first = (w.doc_id, w.line_no) WHERE len(w.s) > 0 AND k.s IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"""
