"""Data flow of statements in basic blocks: which definitions reach which uses, branches and loops included.

``occurrences`` has a row for each variable occurrence: ``unit`` (key), ``block``, ``stmt`` (ascends inside a block), ``pos``
(unique in a unit), ``role`` (``use`` or ``def``), ``name``. A statement's uses come before its definitions. ``flow`` has
the control-flow edges ``unit, src, dst`` between blocks. Rows with nulls in a key meet nothing; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, as the variable of a function over one element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _reached(start: Column, steps: Column, kills: Column) -> Column:
    """The blocks whose start a definition that leaves ``start`` reaches; it ends in the blocks ``kills``, loops included.

    Each round goes on from blocks met for the first time, so no more rounds than steps have any left."""
    onward = lambda front: F.array_distinct(F.transform(F.filter(steps, lambda s: F.array_contains(front, s["src"])), lambda s: s["dst"]))
    state = lambda seen, new: F.struct(seen.alias("seen"), F.array_except(new, kills).alias("front"))
    walk = lambda acc: _bound(F.array_except(onward(acc["front"]), acc["seen"]), lambda new: state(F.concat(acc["seen"], new), new))
    first = _bound(onward(F.array(start)), lambda new: state(new, new))
    return F.aggregate(steps, first, lambda acc, _: F.when(F.size(acc["front"]) > 0, walk(acc)).otherwise(acc), lambda acc: acc["seen"])


def reaching(occurrences: DataFrame, flow: DataFrame) -> DataFrame:
    """``unit, pos, name, def_pos`` of every use: the last definition before it in its own block, else all that reach the block.

    A block's last definition of a name leaves it and enters its successors; what enters a block that does not define the name
    goes on. A use that no definition reaches has one row with a null ``def_pos``. A row holds the occurrences of one name in one
    unit beside the unit's edges; tables that are dealt by ``unit`` (``repartition("unit")``) are not exchanged again."""
    order = Window.partitionBy("unit", "name", "block").orderBy("stmt", F.when(F.col("role") == "use", 0).otherwise(1), "pos")
    made = F.when(F.col("role") == "def", F.col("pos"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = occurrences.withColumn("own", F.last(made, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("final", F.last(made, ignorenulls=True).over(whole) == made)
    use = F.when(F.col("role") == "use", F.struct("pos", "block", "own"))
    leaves = F.when(F.col("final") & F.col("block").isNotNull() & F.col("name").isNotNull(), F.struct("pos", "block"))
    names = placed.groupBy("unit", "name").agg(F.collect_list(use).alias("uses"), F.collect_list(leaves).alias("ends"))
    edges = flow.dropna(subset=["unit", "src", "dst"]).groupBy("unit").agg(F.collect_set(F.struct("src", "dst")).alias("steps"))
    steps = F.coalesce("steps", F.array().cast(edges.schema["steps"].dataType))
    far = F.exists("uses", lambda u: u["own"].isNull())
    both = names.where(F.size("uses") > 0).join(edges, "unit", "left").select("unit", "name", "uses", F.when(far, F.col("ends")).otherwise(F.slice("ends", 1, 0)).alias("ends"), steps.alias("steps"))
    kills = F.transform("ends", lambda e: e["block"])
    facts = _bound(kills, lambda k: F.transform("ends", lambda e: F.struct(e["pos"].alias("pos"), _reached(e["block"], F.col("steps"), k).alias("blocks"))))

    def met(facts, u):
        entering = F.transform(F.filter(facts, lambda f: F.array_contains(f["blocks"], u["block"])), lambda f: f["pos"])
        return F.struct(u["pos"].alias("pos"), F.when(u["own"].isNotNull(), F.array(u["own"])).otherwise(entering).alias("defs"))

    found = both.select("unit", "name", F.explode(_bound(facts, lambda f: F.transform("uses", lambda u: met(f, u)))).alias("u"))
    return found.select("unit", F.col("u.pos").alias("pos"), "name", F.explode_outer("u.defs").alias("def_pos"))


def flow_edges(occurrences: DataFrame, flow: DataFrame) -> DataFrame:
    """``unit, pos, name, kind, source_pos, source_name``: the rows that :func:`metrics.merged_flow` takes.

    A use comes from its definitions (kind ``comesFrom``; no source if there is none); a definition is computed from the
    uses of its statement (``computedFrom``), or comes from nothing."""
    used = reaching(occurrences, flow)
    uses = used.select("unit", "pos", "name", F.lit("comesFrom").alias("kind"), F.col("def_pos").alias("source_pos"), F.when(F.col("def_pos").isNotNull(), F.col("name")).alias("source_name"))
    one = F.struct("pos", "name")
    inside = occurrences.groupBy("unit", "block", "stmt").agg(F.collect_list(F.when(F.col("role") == "def", one)).alias("made"), F.collect_list(F.when(F.col("role") == "use", one)).alias("read"))
    known = F.col("unit").isNotNull() & F.col("block").isNotNull() & F.col("stmt").isNotNull()
    made = inside.select("unit", F.explode("made").alias("m"), F.when(known, F.col("read")).alias("read")).select("unit", "m", F.explode_outer("read").alias("r"))
    kind = F.when(F.col("r").isNull(), "comesFrom").otherwise("computedFrom")
    return uses.unionByName(made.select("unit", "m.pos", "m.name", kind.alias("kind"), F.col("r.pos").alias("source_pos"), F.col("r.name").alias("source_name")))
