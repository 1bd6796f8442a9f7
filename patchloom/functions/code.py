"""Source-text functions that built-ins cannot express, in plain Python, with Arrow wrappers below.

All are pure and per value, so a repeated task gives the same rows. Text in quotes is one unit for
padding and comment removal.
"""

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchloom.functions.differences import DELETE, INSERT, blank_tokens, counts, script
from patchloom.functions.edits import END, FORMS, decode, edit_sequence
from patchloom.functions.edits import apply as apply_edit_sequence
from patchloom.functions.padding import pad_code, strip_comments


def word_diff(a: str | None, b: str | None) -> list[tuple[int, str]]:
    """(-1 deleted, 0 kept, 1 inserted; text) in order, over words with the blank that follows them; pieces of white space
    alone are left out."""
    pieces = ((op, "".join(words)) for op, words in script(blank_tokens(a or ""), blank_tokens(b or "")))
    return [(op, text) for op, text in pieces if not text.isspace()]


def word_counts(a: str | None, b: str | None) -> dict:
    """Words deleted, kept and inserted by a shortest script, over words with the blank that follows them."""
    return dict(zip(("deleted", "kept", "inserted"), counts(blank_tokens(a or ""), blank_tokens(b or "")), strict=True))


def line_hunks(before: str | None, after: str | None) -> list[dict]:
    """Hunks of a line diff: type, and the deleted and added non-blank lines with 0-based numbers."""
    x, y = ((t or "").split("\n") if t else [] for t in (before, after))
    out, i, k, source = [], 0, 0, []
    rows = lambda lines, kind, start: [{"line": t.strip(), "type": kind, "lineNo": n} for n, t in enumerate(lines, start) if t.strip()]

    def close(target):
        if source or target:
            out.append({"type": "MODIFY" if source and target else "DELETE" if source else "ADD", "sourceChanges": source, "targetChanges": target})

    for op, lines in script(x, y):
        if op == DELETE:
            source, i = rows(lines, "DELETE", i), i + len(lines)
        elif op == INSERT:
            close(rows(lines, "ADD", k))
            source, k = [], k + len(lines)
        else:
            close([])
            source, i, k = [], i + len(lines), k + len(lines)
    close([])
    return out


OLD, NEW = FORMS["plain"]


def _once(text: str, part: str) -> bool:
    return text.count(part) == 1


def fold_replacements(broken: str | None, pairs: Iterable | None) -> str | None:
    """Replacements in order of length, longest first, each only where its old part occurs once."""
    text = broken
    for old, new in sorted(((p["old"], p["new"]) for p in pairs if p["old"]) if pairs is not None else [], key=lambda p: -len(p[0])):
        if text is not None and _once(text, old):
            text = text.replace(old, new)
    return text


#: Rows of a batch whose results are Python values at once; inputs become Python values one row at a time.
PIECE = 256


def _arrow(f: Callable, kind: str):
    import pyarrow as pa

    types = {"string": pa.string(), "array<struct<op: int, text: string>>": pa.list_(pa.struct([("op", pa.int32()), ("text", pa.string())]))}
    line = pa.list_(pa.struct([("line", pa.string()), ("type", pa.string()), ("lineNo", pa.int32())]))
    types["hunks"] = pa.list_(pa.struct([("type", pa.string()), ("sourceChanges", line), ("targetChanges", line)]))
    types[COUNTS] = pa.struct([(n, pa.int64()) for n in ("deleted", "kept", "inserted")])
    kind_type = types.get(kind, types["hunks"])

    def each(*columns: pa.Array) -> pa.Array:
        parts = [pa.array([f(*(c[i].as_py() for c in columns)) for i in range(start, min(start + PIECE, len(columns[0])))], kind_type) for start in range(0, len(columns[0]), PIECE)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind_type)

    def one(a: pa.Array) -> pa.Array:
        return each(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return each(a, b)

    return two if f.__code__.co_argcount >= 2 else one


LINES = "array<struct<line: string, type: string, lineNo: int>>"
HUNKS = f"array<struct<type: string, sourceChanges: {LINES}, targetChanges: {LINES}>>"
DIFF = "array<struct<op: int, text: string>>"
COUNTS = "struct<deleted: bigint, kept: bigint, inserted: bigint>"


def _diff_rows(a, b):
    return [{"op": o, "text": t} for o, t in word_diff(a, b)]


def _column(f: Callable, kind: str) -> Callable[..., Column]:
    """Arrow UDF of a pure function; made on use, since modules are also imported where no session exists."""
    return lambda *columns: F.arrow_udf(_arrow(f, kind), kind)(*columns)


padded = _column(pad_code, "string")
without_comments = _column(strip_comments, "string")
diff_words = _column(_diff_rows, DIFF)
counted_words = _column(word_counts, COUNTS)
hunks_of = _column(line_hunks, HUNKS)
make_edit_sequence = _column(edit_sequence, "string")
applied_edit_sequence = _column(apply_edit_sequence, "string")
decoded_edit_sequence = _column(decode, "string")
folded = _column(fold_replacements, "string")
