"""Repair categories of AST actions, as built-in expressions folded in pattern order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The categories.
ARGUMENT, INVOCATION, ORACLE, OTHER = "ARGUMENT", "INVOCATION", "ORACLE", "OTHER"
#: Fixed values: (name, pattern over ``type-nodeType-parent``) in the order in which they are tried.
PATTERNS = (
    ("add_param", "Insert-(.+)-(ConstructorCall|NewClass|Invocation)"),
    ("del_param", "Delete-(.+)-(ConstructorCall|NewClass|Invocation)"),
    ("change_type", "Update-(TypeAccess|TypeAccess,FieldRead|THROWN|VARIABLE_TYPE|TYPE_CASE)-(.+)"),
    ("mod_param", "Update-(Literal|FieldRead|VariableRead)-(.+)"),
    ("mod_call", "Update-Invocation-(.+)"),
    ("add_throws", "Insert-(THROWN_TYPES|THROWN)-(Method|THROWN_TYPES)"),
    ("del_throws", "Delete-(THROWN_TYPES|THROWN)-(Method|THROWN_TYPES)"),
    ("insert_line", "Insert-(Invocation|Assignment|LocalVariable)-(Method|Try|TryWithResource|While|Lambda)"),
    ("del_line", "Delete-(Invocation|Assignment|LocalVariable)-(Method|Try|TryWithResource|While)"),
    ("move", "Move-(.+)-(.+)"),
)
#: The signature of a constructor with and without its package.
QUALIFIED, PLAIN = r"(.+?)((\.(.+?))*?)\.(.+?)\((.*)\)", r"(.+?)\((.*)\)"
BUILT = "Update-ConstructorCall-(.+)"
ARGUMENT_KINDS, INVOCATION_KINDS, ORACLE_KINDS = ("add_param", "del_param", "mod_param", "move"), ("insert_line", "del_line", "mod_call"), ("add_throws", "del_throws")


def action_text(action: Column) -> Column:
    """``type-nodeType-parent``; a type that is accessed to read a field is named with its reader, before the reader's parent."""
    near, far = F.get(action["parents"], F.lit(0)), F.get(action["parents"], F.lit(1))
    reads = F.coalesce((action["nodeType"] == "TypeAccess") & (near == "FieldRead"), F.lit(False))
    return F.when(reads, F.concat_ws("-", action["type"], F.lit("TypeAccess,FieldRead"), far)).otherwise(F.concat_ws("-", action["type"], action["nodeType"], near))


def constructor(label: Column) -> Column:
    """struct(name, n_args) of ``a.b.Name(x,y)`` or ``Name(x,y)``; null if the label is no such signature."""
    qualified, plain = label.rlike(QUALIFIED), label.rlike(PLAIN)
    name = F.when(qualified, F.substring_index(F.regexp_extract(label, QUALIFIED, 5), ".", -1)).otherwise(F.regexp_extract(label, PLAIN, 1))
    arguments = F.when(qualified, F.regexp_extract(label, QUALIFIED, 6)).otherwise(F.regexp_extract(label, PLAIN, 2))
    count = F.when(arguments == "", 0).otherwise(F.size(F.split(arguments, ",")))
    return F.when(qualified | plain, F.struct(name.alias("name"), count.alias("n_args")))


def _asserts(lines: Column, word: Column) -> Column:
    """Whether a line with an assert names ``word``."""
    return F.coalesce(F.exists(lines, lambda x: F.contains(F.lower(x["line"]), F.lit("assert")) & F.contains(x["line"], word)), F.lit(False))


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value computed once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def action_categories(action: Column, source: Column, target: Column) -> Column:
    """Array of categories of one action, given its hunk's deleted and added lines.

    The categories found so far are replaced when a pattern makes the action an oracle change."""
    src, dst = action["srcNode"]["label"], action["dstNode"]["label"]
    facts = F.struct(action_text(action).alias("text"), src.alias("src"), dst.alias("dst"), (_asserts(source, src) | _asserts(target, dst)).alias("in_assert"))
    return _with(facts, lambda x: _categories(x, source, target))


def _categories(facts: Column, source: Column, target: Column) -> Column:
    """The patterns in order, each a step of a fold, so that the expression grows with the number of patterns."""
    text, src, dst, in_assert = facts["text"], facts["src"], facts["dst"], facts["in_assert"]
    named = lambda x, word: F.coalesce(F.contains(x, F.lit(word)), F.lit(False))
    exception = named(dst, "Exception") | named(src, "Exception")
    steps = []
    for name, pattern in PATTERNS:
        hit = F.coalesce(text.rlike(pattern), F.lit(False))
        kind = ARGUMENT if name in ARGUMENT_KINDS or name == "change_type" else INVOCATION if name in INVOCATION_KINDS else None
        adds = F.lit(kind).cast("string") if name != "change_type" else F.when(~exception, kind)
        oracle = F.lit(True) if name in ORACLE_KINDS else (in_assert | exception) if name == "change_type" else in_assert
        if name == "mod_call":  # another assert method is no new oracle
            oracle = oracle & src.isNotNull() & dst.isNotNull() & ~named(src, "assert") & ~named(dst, "assert")
        steps.append(F.when(hit, F.struct(adds.alias("adds"), oracle.alias("oracle"))))
    own_steps = F.filter(F.array(*steps), lambda s: s.isNotNull())
    added = lambda cats, s: F.when(s["oracle"], F.array(F.lit(ORACLE))).when(s["adds"].isNotNull(), F.array_union(cats, F.array(s["adds"]))).otherwise(cats)
    cats = F.aggregate(own_steps, F.array().cast("array<string>"), added)
    return F.when(F.coalesce(text.rlike(BUILT), F.lit(False)), _with(F.struct(constructor(src)["name"].alias("own"), constructor(dst)["name"].alias("other")), lambda x: _built(x["own"], x["other"], source, target))).otherwise(cats)


def _built(own: Column, other: Column, source: Column, target: Column) -> Column:
    """Categories of a constructor call that became another."""
    named = lambda x, word: F.coalesce(F.contains(x, F.lit(word)), F.lit(False))
    kind = F.when(own.eqNullSafe(other), ARGUMENT).otherwise(INVOCATION)
    guarded = named(own, "Exception") | named(other, "Exception") | _asserts(target, other) | _asserts(source, own)
    return F.when(guarded, F.array(kind, F.lit(ORACLE))).otherwise(F.array(kind))


def categorise(repairs: DataFrame) -> DataFrame:
    """``ID, categories, n_actions``: sorted union over a repair's actions, OTHER if there is none."""
    lines = lambda side: F.coalesce(F.col(f"hunk.{side}"), F.array().cast("array<struct<line: string, type: string, lineNo: int>>"))
    own = repairs.select("ID", lines("sourceChanges").alias("s"), lines("targetChanges").alias("t"), F.coalesce("astActions", F.array().cast(repairs.schema["astActions"].dataType)).alias("a"))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("a", lambda a: action_categories(a, F.col("s"), F.col("t"))))))
    return own.select("ID", F.when(F.size(found) == 0, F.array(F.lit(OTHER))).otherwise(found).alias("categories"), F.size("a").alias("n_actions"))
