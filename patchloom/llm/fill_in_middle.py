"""Fill-in-the-middle rewriting of whole texts at token boundaries, by overlapping chunks.

A token is a run of ASCII letters or any other single code point. In UTF-8 a byte opens a token unless it
continues a code point or it and the byte before it are both letters, so one adjacent-byte predicate tells all
boundaries. A document is cut into chunks of :data:`CHUNK` bytes that overlap by the byte before; the chunks of
all documents of a piece are counted at once (tokens and code points), a strip of bounded size at a time. Prefix
sums of these counts route the rank of either cut to the chunk that owns it, and only that chunk is scanned
again for the cut's byte and code points. No text leaves its task: the rewriting is one narrow pass.

The forms: ``plain`` keeps the text; ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm`` is ``<S>``
suffix ``<P>`` prefix ``<M>`` middle. Cuts and form depend on the document's id and ``seed`` alone.

Defined cases: a null text is an empty one, an empty text is plain; a null id is hashed as no digits; texts that
hold a marker stay plain, so every output can be restored; repeated rows give equal rows; equal cuts give an
empty middle; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.batches import pieces, starts

#: Bytes of a chunk, and bytes of text whose boundaries are flagged together.
CHUNK, STRIP = 1 << 12, 1 << 22
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def boundaries(data: np.ndarray, begin: int, end: int, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the bytes ``begin`` to ``end``: opens a token, opens a code point.

    Reads one byte more on the left; ``firsts`` are the offsets (from ``begin``) at which a document starts."""
    lead = 1 if begin else 0
    own = data[begin - lead : end]
    letter = ((own | 32) - 97) < 26
    before = np.concatenate([np.zeros(1 - lead, bool), letter[:-1]])
    before[firsts] = False
    point = (own[lead:] & 0xC0) != 0x80
    return point & ~(letter[lead:] & before), point


class Chunks:
    """The chunks of a piece's texts with the running counts of tokens and code points before each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, strip: int = STRIP):
        self.data, self.offsets = data, offsets
        per_text = -(-np.diff(offsets) // chunk)
        self.first = starts(per_text)
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.opening = within == 0
        self.begin = np.repeat(offsets[:-1], per_text) + within * chunk
        self.end = np.append(self.begin[1:], offsets[-1]) if len(self.begin) else self.begin
        tokens, points = np.zeros(len(self.begin), np.int64), np.zeros(len(self.begin), np.int64)
        at = 0
        while at < len(self.begin):
            to = max(at + 1, int(np.searchsorted(self.end, self.begin[at] + strip, side="right")))
            base = self.begin[at]
            places = self.begin[at:to] - base
            opens, point = boundaries(data, base, self.end[to - 1], places[self.opening[at:to]])
            tokens[at:to], points[at:to] = np.add.reduceat(opens, places, dtype=np.int64), np.add.reduceat(point, places, dtype=np.int64)
            at = to
        self.tokens, self.points = starts(tokens), starts(points)

    def counts(self) -> np.ndarray:
        """Tokens of each text."""
        return np.diff(self.tokens[self.first])

    def cuts(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the byte (from its start) and the code points before its token of that rank; the count is its end."""
        goal = self.tokens[self.first[:-1]] + ranks
        owner = np.searchsorted(self.tokens, goal, side="right") - 1
        size, points = np.diff(self.offsets), np.diff(self.points[self.first])
        for i in np.flatnonzero(ranks < self.counts()):
            c = owner[i]
            opens, point = boundaries(self.data, self.begin[c], self.end[c], np.flatnonzero(self.opening[c : c + 1]))
            place = np.flatnonzero(opens)[goal[i] - self.tokens[c]]
            size[i] = self.begin[c] - self.offsets[i] + place
            points[i] = self.points[c] - self.points[self.first[i]] + np.count_nonzero(point[:place])
        return size, points


def rewrite(text: bytes, form: str, prefix: int, middle: int) -> bytes:
    """The output of a form, cut at the two bytes."""
    if form == "plain":
        return text
    a, b, c = text[:prefix], text[prefix:middle], text[middle:]
    return b"".join((PREFIX, a, SUFFIX, c, MIDDLE, b) if form == "psm" else (SUFFIX, c, PREFIX, a, MIDDLE, b))


def restore(output: bytes, form: str) -> bytes:
    """The text that :func:`rewrite` had; its parts hold no marker, so the first of each kind is the marker."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    first, _, second = head[3:].partition(SUFFIX if form == "psm" else PREFIX)
    return first + middle + second if form == "psm" else second + middle + first


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


OUTPUTS = {
    "output": lambda out, form: out.decode(),
    "restored": lambda out, form: restore(out, form).decode(),
    "output_sha256": lambda out, form: _sha(out),
    "restored_sha256": lambda out, form: _sha(restore(out, form)),
}


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def rewrite_piece(texts: pa.Array, hashes: list[np.ndarray], plain_from: int, spm_below: int, outputs: tuple[str, ...]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and the named outputs of a piece of texts."""
    data, offsets = _texts(texts)
    chunks = Chunks(data, offsets)
    n = chunks.counts()
    one, two = hashes[0] % (n + 1), hashes[1] % (n + 1)
    prefix, prefix_chars = chunks.cuts(np.minimum(one, two))
    middle, upto = chunks.cuts(np.maximum(one, two))
    psm = np.where(hashes[3] % 100 < spm_below, "spm", "psm")
    forms, columns, kept = [], {name: [] for name in outputs}, hashes[2] % 100 < plain_from
    for i in range(len(n)):
        text = data[offsets[i] : offsets[i + 1]].tobytes()
        form = str(psm[i]) if kept[i] and text and not any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) else "plain"
        out = rewrite(text, form, int(prefix[i]), int(middle[i]))
        forms.append(form)
        for name in outputs:
            columns[name].append(OUTPUTS[name](out, form))
    plain = pa.array([f == "plain" for f in forms], pa.bool_())
    hide = lambda counts: pc.if_else(plain, pa.scalar(None, pa.int64()), pa.array(counts, pa.int64()))
    return [pa.array(n, pa.int64()), pa.array(forms, pa.string()), hide(prefix_chars), hide(upto - prefix_chars), *(pa.array(columns[x], pa.string()) for x in outputs)]


def fill_in_middle(docs: DataFrame, outputs: tuple[str, ...] = ("output",), seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and the named :data:`OUTPUTS` for every row of ``docs``.

    ``n`` counts the text's tokens; the two lengths are code points, null for plain texts. ``fim_percent`` of the
    texts are rewritten, ``spm_percent`` of those suffix first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                drawn = [part.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *rewrite_piece(part.column(1), drawn, fim_percent, spm_percent, outputs)], names=names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", *outputs]
    schema = ", ".join(["doc_id long", "n long", "form string", "prefix_chars long", "middle_chars long", *(f"{x} string" for x in outputs)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *hashes).mapInArrow(run, schema)


def oracle() -> str:
    part = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT"
    return f"""
WITH tokens AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS k, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, k, len(k) AS n, {part(0)} % (len(k) + 1) AS a, {part(1)} % (len(k) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {part(2)} % 100 >= 90 THEN 'plain' WHEN {part(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM tokens),
parts AS (SELECT doc_id, t, n, form, array_to_string(k[:least(a, b)], '') AS p, array_to_string(k[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(k[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""
