"""Joins with a rule for several matches, for near matches and for defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.similarity import SIMILARITY_THRESHOLD, jaro_winkler
from patchloom.storage import materialize


def match_join(left: DataFrame, right: DataFrame, key: str, order: Column, payload: list[str], last: bool = False, how: str = "left") -> DataFrame:
    """Each left row with the first (or ``last``) right row of its key by ``order``; the right side is reduced first."""
    pick = F.max_by if last else F.min_by
    one = right.groupBy(F.col(key).alias("_k")).agg(pick(F.struct(*payload), order).alias("_r"))
    return left.join(one, F.col(key) == F.col("_k"), how).select(*left.columns, *[F.col("_r")[p].alias(p) for p in payload])


def nearest_at_least(left: DataFrame, value: str, right: DataFrame, candidate: str, default, name: str) -> DataFrame:
    """The smallest candidate not below ``value``, else ``default``.

    Candidates are a short list of distinct values (installed versions, sizes); it is one array in the
    plan. :func:`range_nearest` serves long lists."""
    options = right.agg(F.array_sort(F.collect_set(candidate))).scalar()
    found = F.array_min(F.filter("_options", lambda x: x >= F.col(value)))
    return left.withColumn("_options", options).withColumn(name, F.coalesce(found, F.lit(default))).drop("_options")


def range_nearest(left: DataFrame, value: str, right: DataFrame, candidate: str, default, name: str, width: float) -> DataFrame:
    """The same for long candidate lists: both sides are cut into cells of ``width`` and joined by cell.

    A cell's own smallest fitting candidate is used; a value above all of its cell's candidates takes the
    first candidate of the next occupied cell, found on the small table of cells."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    cells = right.groupBy(cell(candidate).alias("_cell")).agg(F.array_sort(F.collect_set(candidate)).alias("_own"))
    wanted = left.select(cell(value).alias("_cell")).distinct()
    both = wanted.join(cells, "_cell", "full")
    after = Window.orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)
    both = both.withColumn("_next", F.first(F.get("_own", F.lit(0)), ignorenulls=True).over(after))
    joined = left.withColumn("_cell", cell(value)).join(both, "_cell", "left")
    own = F.array_min(F.filter("_own", lambda x: x >= F.col(value)))
    return joined.withColumn(name, F.coalesce(own, F.col("_next"), F.lit(default))).drop("_cell", "_own", "_next")


def ancestors(path: Column) -> Column:
    """All proper ancestors of a slash-separated path, longest first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def longest_prefix(left: DataFrame, path: str, key: str, known: DataFrame, known_path: str, name: str = "ancestor") -> DataFrame:
    """Nearest ancestor of each path that occurs in ``known``; null if none. One equi-join on exploded ancestors."""
    up = left.select(F.col(key).alias("_id"), F.explode(ancestors(F.col(path))).alias("_up"))
    have = known.select(F.col(known_path).alias("_have")).distinct()
    best = up.join(have, F.col("_up") == F.col("_have")).groupBy("_id").agg(F.max_by("_up", F.length("_up")).alias(name))
    return left.join(best, F.col(key) == F.col("_id"), "left").drop("_id")


def best_match(missing: DataFrame, fresh: DataFrame, keys: list[str], similarity: Column, order: str, least: float, payload: list[str]) -> DataFrame:
    """For each missing row the most similar fresh row of equal ``keys``, if its similarity exceeds ``least``.

    ``similarity`` is an expression over the joined row; ties go to the smaller ``order``."""
    pairs = missing.join(fresh, keys).withColumn("similarity", similarity).where(F.col("similarity") > least)
    best = F.min_by(F.struct("similarity", *payload), F.struct(-F.col("similarity"), F.col(order)))
    return pairs.groupBy(*[c for c in missing.columns]).agg(best.alias("_b")).select(*missing.columns, "_b.*")


# ---- most similar name, exactly, without comparing all pairs -------------------------------------------------------

#: Letters are counted in so many classes for the exact bound of a pair, in so many for the cells of a group.
CLASSES, COARSE = 32, 5


def _letter_counts(name: Column, classes: int) -> Column:
    """Letters of the name in each class of code point."""
    kinds = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(classes)))
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.size(F.filter(kinds, lambda x: x == k)))


def _bound(shared: Column, a: Column, b: Column, prefix: Column) -> Column:
    """No Jaro-Winkler similarity of names of lengths a and b with ``shared`` letters in common exceeds this."""
    jaro = F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0) | (shared == 0), 0.0).otherwise((shared / F.greatest(a, F.lit(1)) + shared / F.greatest(b, F.lit(1)) + 1) / 3)
    return F.when(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro)).otherwise(jaro)


def _in_common(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)


def _same_start(a: Column, b: Column) -> Column:
    return F.greatest(*[F.when((F.length(a) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n))), n).otherwise(0) for n in range(1, 5)])


def _compared(pairs: DataFrame, digits: int) -> DataFrame:
    """Pairs whose bound reaches the best similarity known (``known``), with their similarity."""
    scale = 10.0**digits
    most = _bound(_in_common(F.col("a_counts"), F.col("b_counts")), F.length("a_name"), F.length("b_name"), _same_start(F.col("a_name"), F.col("b_name")))
    return pairs.where(most >= F.col("known") - 1 / scale).withColumn("similarity", F.floor(jaro_winkler("a_name", "b_name") * scale + 0.5) / scale)


def _two_first(rows: DataFrame, group: list[str], order: Column, value: Column) -> DataFrame:
    """``group, two``: the values of the first two rows of each group, in order."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where("_n <= 2")
    return first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value.alias("v")))), lambda x: x["v"]).alias("two"))


def nearest_names(missing: DataFrame, fresh: DataFrame, keys: list[str], name: str, other_name: str, other: str, least: float = SIMILARITY_THRESHOLD, own: str | None = None, digits: int = 6) -> tuple[DataFrame, list[DataFrame]]:
    """``missing`` rows with ``similarity`` and ``other`` of the most similar fresh row of their ``keys``, if above ``least``;
    and the tables of the name pairs that were compared.

    Similarity is Jaro-Winkler, rounded to ``digits``; ties go to the smaller ``other``. ``own`` names a column of ``missing``
    whose equal in ``other`` (a row of the same name) is no match. Null keys or names match nothing.
    Only distinct names meet. A group's names lie in cells of equal length and letter classes. Names of one cell are
    compared first; then cells meet whose counts allow more than that gave, and in them the pairs whose own letters and
    prefix allow it, so nothing that could win is left out. Different names of one cell still meet pair by pair."""
    group = F.struct(*keys)
    named = lambda rows, text: rows.where(F.col(text).isNotNull() & F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
    cell = lambda c: F.struct(F.length(c).alias("n"), _letter_counts(F.col(c), COARSE).alias("c"))
    a = named(missing, name).select(group.alias("g"), F.col(name).alias("a_name")).distinct()
    a = materialize(a.withColumns({"a_counts": _letter_counts(F.col("a_name"), CLASSES), "a_cell": cell("a_name")}), "names")
    ids = named(fresh, other_name).select(group.alias("g"), F.col(other_name).alias("b_name"), F.col(other).alias("o")).distinct()
    b = _two_first(ids, ["g", "b_name"], F.col("o"), F.col("o")).withColumnRenamed("two", "ids")
    b = materialize(b.withColumns({"b_counts": _letter_counts(F.col("b_name"), CLASSES), "b_cell": cell("b_name")}), "names")

    columns = ["g", "a_name", "b_name", "ids", "similarity"]
    near = a.join(b.withColumn("a_cell", F.col("b_cell")), ["g", "a_cell"]).withColumn("known", F.lit(float(least)))
    near = materialize(_compared(near, digits).select(columns), "names-near")
    sure = near.where((F.col("a_name") != F.col("b_name")) | (F.size("ids") > 1)) if own else near
    known = sure.groupBy(F.col("g").alias("kg"), F.col("a_name").alias("kn")).agg(F.max("similarity").alias("known"))
    open_ = a.join(known, (F.col("g") == F.col("kg")) & (F.col("a_name") == F.col("kn")), "left").drop("kg", "kn")
    open_ = open_.withColumn("known", F.greatest(F.coalesce("known", F.lit(0.0)), F.lit(float(least))))
    cells = open_.groupBy("g", "a_cell").agg(F.min("known").alias("low")).join(b.select("g", "b_cell").distinct(), "g").where(F.col("a_cell") != F.col("b_cell"))
    most = _bound(_in_common(F.col("a_cell.c"), F.col("b_cell.c")), F.col("a_cell.n"), F.col("b_cell.n"), F.lit(4))
    far = open_.join(cells.where(most >= F.col("low") - 10.0**-digits).drop("low"), ["g", "a_cell"]).join(b, ["g", "b_cell"])
    far = materialize(_compared(far, digits).select(columns), "names-far")

    scored = near.unionByName(far).where(F.col("similarity") > least).select("g", "a_name", F.explode("ids").alias("o"), "similarity")
    best = _two_first(scored, ["g", "a_name"], F.struct(-F.col("similarity"), F.col("o")), F.struct("similarity", "o"))
    best = best.select(F.col("g").alias("_g"), F.col("a_name").alias("_name"), F.col("two").alias("_two"))
    picked = missing.join(best, (group == F.col("_g")) & (F.col(name) == F.col("_name")))
    best_of = F.get(F.filter("_two", lambda x: x["o"] != F.col(own)), F.lit(0)) if own else F.get("_two", F.lit(0))
    picked = picked.withColumn("_best", best_of).where("_best IS NOT NULL")
    return picked.select(*missing.columns, F.col("_best.similarity").alias("similarity"), F.col("_best.o").alias(other)), [near, far]


#: Rows up to which a counted side of a join is sent to every executor.
SMALL = 1_000_000


def with_small(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``; the right side goes to every executor if its rows, counted first, are few, so that the left side,
    which may have very frequent keys, is not shuffled."""
    right = materialize(right, "join-side")
    return left.join(F.broadcast(right) if right.limit(SMALL + 1).count() <= SMALL else right.hint("merge"), key)


# ---- overlap with a least share ------------------------------------------------------------------------------------


def overlapping(left: DataFrame, right: DataFrame, left_id: str, right_id: str, word: str, share: float) -> DataFrame:
    """``left_id, right_id``: pairs where at least ``share`` of the right row's distinct words are the left row's too.

    Both sides have a row for each word. A right row's words are ordered by how many left rows have them, rarest first; a left
    row with enough of them has one of the first n - ceil(share * n) + 1, so only those few meet. Candidates are then
    counted over all words. A word that most rows have meets nothing unless it is among a row's rarest."""
    a, b = left.select(left_id, word).distinct(), right.select(right_id, word).distinct()
    often = a.groupBy(F.col(word).alias("_w")).agg(F.count("*").alias("_often"))
    ranked = b.join(often, F.col(word) == F.col("_w"), "left").drop("_w")
    order = Window.partitionBy(right_id).orderBy(F.coalesce("_often", F.lit(0)), word)
    ranked = ranked.withColumns({"_n": F.count("*").over(Window.partitionBy(right_id)), "_k": F.row_number().over(order)})
    need = F.ceil(F.col("_n") * share)
    ranked = ranked.withColumn("_need", need)
    rare = ranked.where(F.col("_k") <= F.col("_n") - F.col("_need") + 1).select(right_id, word, "_need")
    candidates = a.join(rare, word).select(left_id, right_id, "_need").distinct()
    counted = candidates.join(b, right_id).join(a.select(F.col(left_id).alias("_l"), F.col(word).alias("_w")), (F.col(left_id) == F.col("_l")) & (F.col(word) == F.col("_w")))
    return counted.groupBy(left_id, right_id, "_need").agg(F.count("*").alias("_c")).where(F.col("_c") >= F.col("_need")).select(left_id, right_id)
