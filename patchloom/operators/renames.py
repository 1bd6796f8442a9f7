"""Renamed elements of two versions, mined from what each version declares and where it uses it.

Elements are rows ``commit, kind, name``; uses are rows ``commit, user, slot, name``: the element that uses, the place in it
(such as the number of the reference), and the name that stands there. A name that only the earlier version declares and one
that only the later declares are a candidate pair if places moved from the one to the other; each such place is a vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.storage import materialize

PAIR = ["commit", "kind", "originalName", "newName"]

#: Names of the three mined kinds.
RENAME_CLASS, MOVE_RENAME_CLASS, RENAME_METHOD = "RENAME_CLASS", "MOVE_RENAME_CLASS", "RENAME_METHOD"


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``commit, name, gone, gained``: the kinds in which only the earlier and only the later version declares a name."""
    side = lambda version, own: version.select("commit", "kind", "name", F.lit(own).alias("own")).dropna()
    both = side(before, True).unionByName(side(after, False)).repartition("commit", "name")
    kinds = lambda own: F.collect_set(F.when(own, F.col("kind")))
    each = both.groupBy("commit", "name").agg(kinds(F.col("own")).alias("was"), kinds(~F.col("own")).alias("now"))
    return each.select("commit", "name", F.array_except("was", "now").alias("gone"), F.array_except("now", "was").alias("gained"))


def _moved(uses_before: DataFrame, uses_after: DataFrame) -> DataFrame:
    """``commit, originalName, newName`` of the places at which each version has one name, and another one.

    A place with several names tells nothing. Both versions are one exchange, in which a use brings its name once."""
    side = lambda uses, own: uses.select("commit", "user", "slot", F.lit(own).alias("own"), "name").dropna()
    both = side(uses_before, True).unionByName(side(uses_after, False)).repartition("commit", "user", "slot")
    was, now = F.when(F.col("own"), F.col("name")), F.when(~F.col("own"), F.col("name"))
    each = both.groupBy("commit", "user", "slot").agg(F.min(was).alias("originalName"), F.max(was).alias("_was"), F.min(now).alias("newName"), F.max(now).alias("_now"))
    return each.where("originalName = _was AND newName = _now AND originalName <> newName").select("commit", "originalName", "newName")


def rename_votes(before: DataFrame, after: DataFrame, uses_before: DataFrame, uses_after: DataFrame) -> DataFrame:
    """``commit, kind, originalName, newName, votes`` of all candidate pairs that at least one place votes for.

    A place has one name in each version, so it brings one vote and no name, however frequent, meets all others."""
    changed = _changed(before, after)
    gone = changed.where(F.size("gone") > 0).select("commit", F.col("name").alias("originalName"), "gone")
    gained = changed.where(F.size("gained") > 0).select("commit", F.col("name").alias("newName"), "gained")
    pairs = _moved(uses_before, uses_after).join(gone, ["commit", "originalName"]).join(gained, ["commit", "newName"])
    return pairs.select("commit", F.explode(F.array_intersect("gone", "gained")).alias("kind"), "originalName", "newName").groupBy(*PAIR).agg(F.count("*").alias("votes"))


def assign(votes: DataFrame) -> DataFrame:
    """``votes`` thinned to a one-to-one assignment: that of taking pairs by most votes, then names, while both ends are free.

    A round takes every pair that is the best of both its ends at once, which is stable as both rank by the same order. Rounds
    grow with the longest chain of pairs each of which waits for the next, not with the number of pairs. A round exchanges what
    is left twice, by old and by new names, and writes it once."""
    by_old, by_new = (Window.partitionBy("commit", "kind", end) for end in ("originalName", "newName"))
    best = lambda end, other: F.row_number().over(end.orderBy(F.desc("votes"), other)) == 1
    free = lambda left, end: left.withColumn("_gone", F.max("_taken").over(end)).where("_taken OR NOT _gone").drop("_gone")
    left, taken = votes.select(*PAIR, "votes").withColumn("_best", best(by_new, "originalName")), []
    while True:
        told = free(left.withColumn("_taken", best(by_old, "newName") & F.col("_best")), by_old)
        told = free(told, by_new).withColumn("_best", best(by_new, "originalName"))
        done = materialize(told.select(*PAIR, "votes", "_best", "_taken"), "rename-round", by="_taken")
        taken.append(done.where("_taken").select(*PAIR, "votes"))
        left = done.where("NOT _taken").drop("_taken")
        if left.isEmpty():
            break
    found = taken[0]
    for part in taken[1:]:
        found = found.unionByName(part)
    return found


def _any_renamed(uses: DataFrame, found: DataFrame) -> bool:
    """Whether an element of ``found`` may be a user: told by hashes, which are a small part of the names."""
    own = lambda rows, name: rows.select(F.xxhash64("commit", name).alias("h")).distinct()
    return not own(uses, "user").join(own(found, "originalName"), "h", "left_semi").isEmpty()


def renamed_elements(before: DataFrame, after: DataFrame, uses_before: DataFrame, uses_after: DataFrame) -> DataFrame:
    """``commit, kind, originalName, newName, votes``: which element became which, one to one within commit and kind.

    What is renamed takes its own places along: once pairs are found, the uses inside them are read under the new name and
    vote for what is still open, until no pair is added (as often as renamed users are nested). A pair that got a vote is found
    or has an end that is, so only places under a new name can vote for an open one: no other place is read again. Rows
    with a null commit, kind or name take no part, repeated rows count once, an element that no place moved with is not found,
    and empty tables give no row.
    """
    found = assign(rename_votes(before, after, uses_before, uses_after))
    last = found
    while _any_renamed(uses_before, last):
        known = found.groupBy("commit", F.col("originalName").alias("user")).agg(F.min("newName").alias("_now"))
        named = found.select("commit", F.col("newName").alias("user")).distinct()
        users = known.unionByName(named.join(known, ["commit", "user"], "left_anti").withColumn("_now", F.col("user")))
        uses = uses_before.join(users, ["commit", "user"]).select("commit", F.col("_now").alias("user"), "slot", "name")
        open_votes = rename_votes(before, after, uses, uses_after.join(named, ["commit", "user"], "left_semi"))
        for end in ("originalName", "newName"):
            open_votes = open_votes.join(found.select("commit", "kind", end), ["commit", "kind", end], "left_anti")
        last = assign(open_votes)
        found = materialize(found.unionByName(last), "renames")
    return found


def _owner(name: Column) -> Column:
    return F.substring_index(name, "#", 1)


def _simple(name: Column) -> Column:
    """The name without package or owner, parameters left out."""
    own = F.substring_index(F.substring_index(name, "#", -1), "(", 1)
    return F.substring_index(own, ".", -1)


def _package(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def mined_renames(before: DataFrame, after: DataFrame, uses_before: DataFrame, uses_after: DataFrame) -> DataFrame:
    """``commit, refactoringType, originalName, newName, votes`` of renamed classes (kind ``class``, name ``a.b.C``) and methods
    (kind ``method``, name ``a.b.C#m(int)``).

    A class whose package differs too is moved and renamed; one with the same simple name has only moved and is left out.
    A method counts if its own name differs and its class stayed or is the one that its former class became."""
    found = renamed_elements(before, after, uses_before, uses_after)
    old, new = F.col("originalName"), F.col("newName")
    kind = F.when(_package(old) == _package(new), RENAME_CLASS).otherwise(MOVE_RENAME_CLASS)
    columns = ["commit", "refactoringType", "originalName", "newName", "votes"]
    named = found.where(_simple(old) != _simple(new))
    classes = named.where("kind = 'class'").withColumn("refactoringType", kind)
    became = found.where("kind = 'class'").select("commit", F.col("originalName").alias("_from"), F.col("newName").alias("_to"))
    methods = named.where("kind = 'method'").withColumn("_from", _owner(old)).join(became, ["commit", "_from"], "left")
    methods = methods.where(F.coalesce("_to", "_from") == _owner(new)).withColumn("refactoringType", F.lit(RENAME_METHOD))
    return classes.select(*columns).unionByName(methods.select(*columns))
