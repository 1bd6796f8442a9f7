"""Benchmark decontamination by typed templates (DataFrame functions only).

Text is canonicalised word by word: numbers, units after a number and names become typed placeholders, the
rest is lower-cased. It is read twice: the narrow reading takes only capitalised words inside a sentence
for names, the wide one every capitalised word, as a name may open a sentence, a line or the text. Windows
of ``window`` template words of every document are hash-joined with the windows of the benchmark items of
the same reading. For each document, item, reading and alignment (document position minus item position)
the slots are then checked: a word of the item that stands in several slots must be matched by one and the
same word, so a re-parameterised question is caught and a chance run of placeholders is not. Two numbers may be
equal by chance (three hardly are), so an alignment in which only numbers that the item has twice disagree
still stands if it covers ``similarity`` of the item's windows by itself. A document is contaminated by an item if in either reading the alignments that
stand cover at least ``similarity`` of the item's windows; the figures are the narrow reading's if that one
suffices. The SQL has both readings.

An item of fewer words than the window is one window of all its words. With fewer than ``SHORT_PLAIN`` plain
words it says too little to be looked for inside a text, and only a document of just its words matches it.

Windows with fewer than two plain words say little and are left out, unless an item has no other. The
items' windows are broadcast only if their counted number is at most ``broadcast_rows``; more are joined
by a shuffle that adaptive execution splits.

Defined cases: null and empty texts have no window and match nothing; repeated rows are judged alike; rows that share a doc_id are judged by
their own text; null ids take part; extra columns are ignored or, when documents are filtered, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.columns import fresh
from patchloom.storage import materialize

SPACE = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
#: Units that may follow a number.
UNITS = ("km", "kg", "cm", "mm", "ml", "mg", "m", "g", "l", "s", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "miles", "metres", "meters", "litres", "dollars", "euros", "percent", "%")
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
#: Fixed values: (pattern, replacement) in order; names twice, as neighbours share the space between them.
STEPS = (
    (r"[0-9]+(?:[.,:/-][0-9]+)*", NUMBER),
    (rf"({NUMBER}[ \t]?)(?:{'|'.join(UNITS)})([\x20\x09-\x0D.,;:!?)]|$)", "$1" + UNIT + "$2"),
    (r"([^.!?:;\x20\x09-\x0D][ \t]+)\p{Lu}\p{Ll}+", "$1" + NAME),
    (r"([^.!?:;\x20\x09-\x0D][ \t]+)\p{Lu}\p{Ll}+", "$1" + NAME),
)
#: A capitalised word that opens a sentence, a line or the text, or follows an opening sign.
OPENING = r"(^|[\x20\x09-\x0D\"'(\[])\p{Lu}\p{Ll}+"
NARROW, WIDE, BOTH = 0, 1, 2
SHORT_PLAIN = 3
SLOT = f"[{NUMBER}{NAME}{UNIT}]"


def template(text: Column, wide: bool = False) -> Column:
    """The canonical text; it has the same words, in number and order, as the text."""
    out = F.btrim(text, F.lit(BLANK))
    for pattern, put in STEPS:
        out = F.regexp_replace(out, pattern, put)
    return F.lower(F.regexp_replace(out, OPENING, "$1" + NAME) if wide else out)


def _words(text: Column) -> Column:
    return F.split(text, SPACE)


def _windows(rows: DataFrame, window: Column, *keep: str) -> DataFrame:
    """``pos, reading, key`` and the ``keep`` columns for every window of ``words`` and of ``wide_words``.

    A window that both readings make alike is one row, of the reading ``BOTH``."""
    long = rows.where(F.size("words") >= window)
    each = long.select(*keep, "words", "wide_words", F.explode(F.sequence(F.lit(1), F.size("words") - window + 1)).alias("pos"))
    key = lambda c: F.xxhash64(F.slice(c, F.col("pos"), window))
    row = lambda reading, k: F.struct(F.lit(reading).alias("reading"), F.col(k).alias("key"))
    each = each.withColumns({"narrow_key": key("words"), "wide_key": key("wide_words")})
    keys = F.when(F.col("narrow_key") == F.col("wide_key"), F.array(row(BOTH, "narrow_key"))).otherwise(F.array(row(NARROW, "narrow_key"), row(WIDE, "wide_key")))
    return each.select(*keep, "words", "wide_words", "pos", F.inline(keys))


def _read_items(benchmark: DataFrame) -> DataFrame:
    own = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    text = F.col("text")
    rows = own.select("item_id", F.xxhash64("text").alias("item_text"), _words(template(text)).alias("words"), _words(template(text, True)).alias("wide_words"), _words(F.btrim("text", F.lit(BLANK))).alias("plain"))
    numbers = F.filter(F.transform("words", lambda w, i: F.when(w.contains(NUMBER), F.get("plain", i))), lambda x: x.isNotNull())
    rows = rows.withColumn("numbers", numbers).withColumn("loose", F.filter(F.array_distinct("numbers"), lambda v: F.size(F.filter("numbers", lambda x: x == v)) <= 2))
    return rows.drop("numbers").where(F.element_at("plain", 1) != "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """The informative windows of each distinct item in each reading, with its slots and its number of windows.

    ``size`` is ``window``, or the words of an item that has fewer; ``whole`` says that only a text of just these words is meant."""
    items = _read_items(benchmark).withColumn("size", F.least(F.size("plain"), F.lit(window)))
    each = _windows(items, F.col("size"), "item_id", "item_text", "plain", "size", "loose")
    each = each.withColumn("reading", F.explode(F.when(F.col("reading") == BOTH, F.array(F.lit(NARROW), F.lit(WIDE))).otherwise(F.array("reading"))))
    at = F.slice(F.when(F.col("reading") == WIDE, F.col("wide_words")).otherwise(F.col("words")), F.col("pos"), F.col("size"))
    places = F.sequence(F.lit(0), F.col("size") - 1)
    slots = F.filter(places, lambda i: F.get(at, i).rlike(SLOT))
    own = F.slice("plain", F.col("pos"), F.col("size"))
    numbers = F.filter(places, lambda i: F.get(at, i).contains(NUMBER) & F.array_contains("loose", F.get(own, i)))
    each = each.select("item_id", "item_text", "reading", "key", "size", F.col("pos").alias("item_pos"), slots.alias("slots"), numbers.alias("numbers"), own.alias("item_words"))
    each = each.withColumn("plain_words", F.col("size") - F.size("slots")).withColumn("whole", (F.col("size") < window) & (F.col("plain_words") < SHORT_PLAIN))
    same = F.col("item_id").eqNullSafe(F.col("bi")) & (F.col("item_text") == F.col("bt")) & (F.col("reading") == F.col("br"))
    by, renamed = ("item_id", "item_text", "reading"), {"item_id": "bi", "item_text": "bt", "reading": "br"}
    best = each.groupBy(*by).agg(F.max(F.least("plain_words", F.lit(2))).alias("need")).withColumnsRenamed(renamed)
    told = each.join(best, same).where("plain_words >= need").drop("bi", "bt", "br", "need", "plain_words")
    sizes = told.groupBy(*by).agg(F.count("*").alias("n_windows")).withColumnsRenamed(renamed)
    return told.join(sizes, same).drop("bi", "bt", "br")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 5, similarity: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """``doc_id, th, item_id, n_windows, n_matched, coverage`` of every contaminated document (a table)."""
    items = materialize(item_windows(benchmark, window), "item-windows")
    few = items.count() <= broadcast_rows
    sizes = [r.size for r in items.select("size").distinct().collect()]  # at most ``window`` numbers
    items = items.withColumnsRenamed({"key": "item_key", "reading": "item_reading"})
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").withColumn("th", F.xxhash64("text"))
    rows = own.select("doc_id", "th", "text", _words(template(F.col("text"))).alias("words"), _words(template(F.col("text"), True)).alias("wide_words"))
    read_alike = (F.col("key") == F.col("item_key")) & ((F.col("reading") == BOTH) | (F.col("reading") == F.col("item_reading"))) & (~F.col("whole") | (F.col("n_words") == F.col("size")))
    hits = None
    for size in sizes or [window]:
        own_size = items.where(F.col("size") == size)
        if few:  # the windows stay where they are, with their text
            found = _windows(rows, F.lit(size), "doc_id", "th", "text").withColumn("n_words", F.size("words")).join(F.broadcast(own_size), read_alike)
        else:  # only keys and places are exchanged; the texts of documents with a hit are fetched after
            found = _windows(rows, F.lit(size), "doc_id", "th").withColumn("n_words", F.size("words")).select("doc_id", "th", "pos", "reading", "key", "n_words").join(own_size, read_alike)
            texts = own.select(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th"), "text").dropDuplicates(["own_id", "own_th"])
            found = found.join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th")))
        found = found.select("doc_id", "th", "text", "pos", "item_id", "item_text", "item_reading", "n_windows", "item_pos", "item_words", "slots", "numbers", "size")
        hits = found if hits is None else hits.unionByName(found)
    doc_words = F.slice(_words(F.btrim("text", F.lit(BLANK))), F.col("pos"), F.col("size"))
    pairs = F.transform("slots", lambda i: F.struct(F.get("item_words", i).alias("iv"), F.get(doc_words, i).alias("dv"), F.array_contains("numbers", i).alias("number")))
    hits = hits.select(
        "doc_id", "th", "item_id", "item_text", "item_reading", "n_windows", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"),
        F.when(F.size("slots") > 0, pairs).otherwise(F.array().cast("array<struct<iv: string, dv: string, number: boolean>>")).alias("pairs"),
    )
    # an alignment holds at most one row for each window of the item, a document at most its own length
    aligned = hits.groupBy("doc_id", "th", "item_id", "item_text", "item_reading", "n_windows", "shift").agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    one_to_one = lambda pairs: F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["iv"])))
    alone = F.size("at") >= F.lit(similarity) * F.col("n_windows")
    stands = one_to_one(F.col("pairs")) | (alone & one_to_one(F.filter("pairs", lambda p: ~p["number"])))
    found = aligned.where(stands).groupBy("doc_id", "th", "item_id", "item_text", "item_reading", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_matched"))
    judged = found.where(F.col("n_matched") >= F.lit(similarity) * F.col("n_windows"))
    judged = judged.groupBy("doc_id", "th", "item_id").agg(F.max_by(F.struct("n_windows", "n_matched"), F.struct(-F.col("item_reading"), F.col("n_matched"), F.col("n_windows"))).alias("b"))
    out = judged.select("doc_id", "th", "item_id", F.col("b.n_windows").cast("long").alias("n_windows"), F.col("b.n_matched").cast("long").alias("n_matched"))
    return materialize(out, "contamination")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 5, similarity: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` (all columns) that no item contaminates."""
    own_id, own_text = fresh(docs, "_id", "_text_hash")
    bad = contamination(docs, benchmark, window, similarity).select(F.col("doc_id").alias(own_id), F.col("th").alias(own_text)).distinct()
    bad = materialize(bad, "contaminated")
    if bad.count() <= broadcast_rows:
        bad = F.broadcast(bad)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_text))
    return docs.join(bad, same, "left_anti")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched``: one row for each contaminated document and item."""
    return contamination(docs, benchmark, window, similarity).groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"))


def oracle(window: int = 5, similarity: float = 0.8) -> str:
    def canonical(x: str, wide: bool) -> str:
        out = f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
        for pattern, put in STEPS + (((OPENING, "$1" + NAME),) if wide else ()):
            put = put.replace("$1", "\\1").replace("$2", "\\2")
            quoted = pattern.replace("'", "''")
            for c in (NUMBER, NAME, UNIT):
                quoted, put = quoted.replace(c, f"' || chr({ord(c)}) || '"), put.replace(c, f"' || chr({ord(c)}) || '")
            out = f"regexp_replace({out}, '{quoted}', '{put}', 'g')"
        return f"regexp_split_to_array(lower({out}), '[\\x20\\x09-\\x0D]+')"

    plain = "regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')"
    both = lambda source, names: " UNION ALL ".join(f"SELECT DISTINCT {names}, text, {r} AS reading, {canonical('text', r == WIDE)} AS words, {plain} AS plain FROM {source} WHERE text IS NOT NULL" for r in (NARROW, WIDE))
    slot = lambda x: f"regexp_matches({x}, '[' || chr(1) || chr(2) || chr(3) || ']')"
    unmixed = lambda pairs: f"len({pairs}) = len(list_distinct(list_transform({pairs}, lambda p: p.iv)))"
    return f"""
WITH i AS (SELECT *, least(len(words), {window}) AS size, list_filter(list_transform(range(1, len(words) + 1), lambda j: CASE WHEN contains(words[j], chr(1)) THEN plain[j] END), lambda x: x IS NOT NULL) AS numbers FROM ({both('benchmark', 'item_id')}) WHERE plain[1] <> ''),
iw0 AS (SELECT item_id, text, reading, size, numbers, pos, list_slice(words, pos, pos + size - 1) AS k, list_slice(plain, pos, pos + size - 1) AS item_words FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS pos FROM i)),
iw1 AS (SELECT *, size - len(list_filter(k, lambda x: {slot('x')})) AS plain_words FROM iw0),
iw2 AS (SELECT *, max(least(plain_words, 2)) OVER (PARTITION BY item_id, text, reading) AS need, size < {window} AND plain_words < {SHORT_PLAIN} AS whole FROM iw1),
iw AS (SELECT item_id, text AS item_text, reading, size, whole, numbers, pos AS item_pos, k, item_words, count(*) OVER (PARTITION BY item_id, text, reading) AS n_windows FROM iw2 WHERE plain_words >= need),
d AS (SELECT *, unnest((SELECT list(DISTINCT size) FROM iw)) AS size FROM ({both('documents', 'doc_id')})),
dw AS (SELECT doc_id, text, reading, size, len(words) AS n_words, pos, list_slice(words, pos, pos + size - 1) AS k, list_slice(plain, pos, pos + size - 1) AS doc_words FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS pos FROM d WHERE len(words) >= size)),
h AS (SELECT doc_id, dw.text, item_id, item_text, dw.reading, n_windows, item_pos, pos - item_pos AS shift,
  list_filter(list_transform(range(1, dw.size + 1), lambda j: CASE WHEN {slot('dw.k[j]')} THEN {{'iv': item_words[j], 'dv': doc_words[j], 'number': contains(dw.k[j], chr(1)) AND len(list_filter(numbers, lambda x: x = item_words[j])) <= 2}} END), lambda x: x IS NOT NULL) AS pairs
  FROM dw JOIN iw ON dw.k = iw.k AND dw.reading = iw.reading AND dw.size = iw.size AND (NOT whole OR n_words = dw.size)),
a AS (SELECT doc_id, text, item_id, item_text, reading, n_windows, shift, list(DISTINCT item_pos) AS seen, list_distinct(flatten(list(pairs))) AS pairs FROM h GROUP BY ALL),
c AS (SELECT doc_id, text, item_id, item_text, reading, n_windows, len(list_distinct(flatten(list(seen)))) AS n_matched FROM a
  WHERE {unmixed('pairs')} OR (len(seen) >= {similarity} * n_windows AND {unmixed('list_filter(pairs, lambda p: NOT p.number)')}) GROUP BY doc_id, text, item_id, item_text, reading, n_windows),
j AS (SELECT doc_id, text, item_id, arg_max({{'w': n_windows, 'm': n_matched}}, [-reading, n_matched, n_windows]) AS b FROM c WHERE n_matched >= {similarity} * n_windows GROUP BY doc_id, text, item_id)
SELECT doc_id, item_id, CAST(max(b.w) AS BIGINT) AS n_windows, CAST(max(b.m) AS BIGINT) AS n_matched FROM j GROUP BY doc_id, item_id"""
