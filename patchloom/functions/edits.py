"""Edit sequences: replacements by old and new text that turn one text into another, in several forms.

A sequence is a row of blocks ``<old marker> old <new marker> new [<replaceEnd>]``. A plain block replaces its old
text, which must stand exactly once in the text it is applied to. Where the changed words alone are not unique, or
nothing is deleted, the block takes unchanged neighbours along on both sides of the replacement, and its marker
says on which side they stand: before, after, or both. Where neighbours alone do not help, blocks that come to
overlap are made one group.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass

from patchloom.functions.padding import pad_code

#: The markers. Old and new of a plain replacement, of one that keeps words before, after or on both sides, and of a group.
FORMS = {
    "plain": ("[<replaceOld>]", "[<replaceNew>]"),
    "before": ("[<replaceOldKeepBefore>]", "[<replaceNewKeepBefore>]"),
    "after": ("[<replaceOldKeepAfter>]", "[<replaceNewKeepAfter>]"),
    "around": ("[<replaceOldKeepBeforeAfter>]", "[<replaceNewKeepBeforeAfter>]"),
    "group": ("[<replaceOldGroup>]", "[<replaceNewGroup>]"),
}
END = "[<replaceEnd>]"
INVALID = "Invalid Prediction"
OLDS, NEWS = {old: form for form, (old, _) in FORMS.items()}, {new: form for form, (_, new) in FORMS.items()}


@dataclass(frozen=True)
class Block:
    """One replacement of words: ``form`` says which of the words are unchanged neighbours."""

    form: str
    old: tuple[str, ...]
    new: tuple[str, ...]

    def text(self) -> str:
        old, new = FORMS[self.form]
        return " ".join([old, *self.old, new, *self.new, END])


@dataclass
class Span:
    """Words ``i:j`` of the source that become ``k:m`` of the target, with unchanged words taken along on either side."""

    i: int
    j: int
    k: int
    m: int
    before: int = 0
    after: int = 0
    group: bool = False

    def form(self) -> str:
        return "group" if self.group else "around" if self.before and self.after else "before" if self.before else "after" if self.after else "plain"


def normal_operations(source: list[str], target: list[str]) -> list[Span]:
    """The changed spans of a word diff; spans that touch are one, so between two there is an unchanged word."""
    out: list[Span] = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, source, target, autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        if out and out[-1].j == i and out[-1].m == k:
            out[-1].j, out[-1].m = j, m
        else:
            out.append(Span(i, j, k, m))
    return out


def _options(before: int, after: int):
    """How many unchanged words to take along on either side: none, then more and more before, after, and on both sides."""
    yield 0, 0
    yield from ((n, 0) for n in range(1, before + 1))
    yield from ((0, n) for n in range(1, after + 1))
    if before and after:
        yield from ((min(n, before), min(n, after)) for n in range(1, max(before, after) + 1))


def build(source: str, target: str) -> list[Block] | None:
    """Blocks that give ``target`` when applied to ``source`` from the last to the first; None if that needs the whole text.

    Each span takes the first of its options whose old text the source holds once; a span that has none is grouped
    with its neighbour, the unchanged words between them included."""
    x, y = source.split(" "), target.split(" ")
    spans, at = normal_operations(x, y), 0
    while at < len(spans):
        s = spans[at]
        room = (s.i - (spans[at - 1].j if at else 0), (spans[at + 1].i if at + 1 < len(spans) else len(x)) - s.j)
        for s.before, s.after in _options(*((0, 0) if s.group else room)):
            old = " ".join(x[s.i - s.before : s.j + s.after])
            if old and source.count(old) == 1:
                break
        else:
            if len(spans) == 1:
                return None
            low = at if at + 1 < len(spans) else at - 1
            p, q = spans[low : low + 2]
            spans[low : low + 2] = [Span(p.i, q.j, p.k, q.m, group=True)]
            at = low
            continue
        at += 1
    return [Block(s.form(), tuple(x[s.i - s.before : s.j + s.after]), (*x[s.i - s.before : s.i], *y[s.k : s.m], *x[s.j : s.j + s.after])) for s in spans] or None


def default_sequence(source: str, target: str) -> str:
    """One block that replaces the whole text."""
    old, new = FORMS["plain"]
    return f"{old} {source} {new} {target} {END}"


def edit_sequence(source: str | None, target: str | None) -> str | None:
    """The blocks that turn ``source`` into ``target``, checked by applying them; else the one whole replacement."""
    if source is None or target is None:
        return None
    blocks = build(source, target) if source and source != target else None
    if blocks:
        sequence = " ".join(b.text() for b in blocks)
        if apply(source, sequence) == target:
            return sequence
    return default_sequence(source, target)


def is_default(source: str | None, target: str | None, sequence: str | None) -> bool | None:
    return None if source is None or target is None or sequence is None else sequence == default_sequence(source, target)


def parse(sequence: str) -> list[tuple[str, str, str]] | None:
    """(form, old, new) of every block; None if the text is no sequence."""
    out = []
    for part in sequence.split(END):
        part = part.strip()
        if not part:
            continue
        old_mark = next((o for o in OLDS if part.startswith(o)), None)
        if old_mark is None:
            return None
        new_mark = FORMS[OLDS[old_mark]][1]
        if part.count(new_mark) != 1:
            return None
        old, new = part[len(old_mark) :].split(new_mark)
        out.append((OLDS[old_mark], old.strip(), new.strip()))
    return out or None


def apply(source: str | None, sequence: str | None) -> str | None:
    """The edited text; None if the sequence is malformed or an old text does not stand exactly once before the last edit.

    The source is padded first; blocks are applied from the last to the first."""
    if source is None or sequence is None or END not in sequence:
        return None
    blocks = parse(sequence)
    if blocks is None:
        return None
    text = pad_code(source)
    limit = len(text)
    for _, old, new in reversed(blocks):
        if not old or text.count(old, 0, limit + len(old) - 1) != 1:
            return None
        limit = text.index(old)
        text = text[:limit] + new + text[limit + len(old) :]
    return " ".join(w for w in text.split(" ") if w)


def strip_special(sequence: str, specials) -> str:
    """The text without a tokenizer's special tokens, longest first; the markers of a sequence stay.

    Of two blanks that come together where a token stood one stays."""
    keep = {END, *OLDS, *NEWS}
    marks = sorted((t for t in specials if t and t not in keep), key=len, reverse=True)
    out, at = [], 0
    while at < len(sequence):
        mark = next((t for t in marks if sequence.startswith(t, at)), None)
        if mark is None:
            out.append(sequence[at])
            at += 1
            continue
        at += len(mark)
        if out and out[-1] == " " and sequence.startswith(" ", at):
            at += 1
    return "".join(out).strip()


def decode(source: str | None, prediction: str | None, specials=()) -> str | None:
    """What a predicted sequence makes of ``source``; :data:`INVALID` if it cannot be applied."""
    if source is None or prediction is None:
        return None
    done = apply(source, strip_special(prediction, specials))
    return done.strip() if done else INVALID
