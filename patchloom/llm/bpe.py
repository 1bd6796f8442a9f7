"""Byte-pair encoding and decoding of whole texts by speculation and verification.

Texts are taken in pieces of bounded size. The distinct white-space-free chunks of a piece are cut into words,
and its distinct words are encoded together. Speculate: one automaton scan cuts every word by greedy longest
match over the vocabulary. Verify: a cut equals the merge result exactly if every token merges to itself and
every adjacent pair of tokens, merged on its own, comes back as that pair. All pairs are tested at once: the
merges on both sides of each seam are undone in reverse order, and a pair fails as soon as the two tokens that
meet at the seam would have merged earlier than what was undone last (sorted tables of pairs, array lookups).
Words that fail the test, and only those, go through exact merging (lowest rank first, leftmost first). Token
lists and their texts are then taken for every chunk of every text by position; nothing is kept between pieces.

The tokenizer's file is a parameter and is read, never trained: a ``tokenizers`` JSON with a BPE model
with word ends, NFC + white-space + lower-case normalisation and a split into contractions, letters,
single numbers and other signs. Added tokens in a text are recognised as the library does by default.

Defined cases: null and empty texts give no tokens; a text of any length is encoded whole; repeated rows
are returned each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.batches import coded_words, pieces, starts, white_space_words

END, STOP = "</w>", "\x00"
#: The white space of Unicode.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: how normalised text is cut into words.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
CHUNKS = regex.compile(rf"[^{SPACE}]+")
SEPARATORS = "[\x1c-\x1f]"
#: Chunks of letters whose lower case and composition are plain, with at most one sign at the end.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
SIGN = "[.,;:!?]"
NEVER = 1 << 40
#: Longer words are merged one by one.
ROW = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {}, 256
    for b in range(256):
        letters[b] = chr(b) if b in plain else chr(spare)
        spare += b not in plain
    return [letters[b] for b in range(256)]


def _lists(values, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


@dataclass
class Encoded:
    """The tokens of a piece: a list for each distinct chunk, and which chunks make up each text."""

    chunks: pa.ListArray
    index: np.ndarray
    offsets: np.ndarray
    names: pa.Array
    tokens: pa.Array

    def sizes(self) -> np.ndarray:
        each = np.diff(self.chunks.offsets.to_numpy())
        return np.diff(starts(each[self.index])[self.offsets])

    def ids(self) -> pa.ListArray:
        taken = self.chunks.take(pa.array(self.index))
        return _lists(taken.flatten(), taken.offsets.to_numpy()[self.offsets])

    def joined(self, table: pa.Array) -> pa.Array:
        """For each text, the entries of its tokens in ``table`` joined by spaces."""
        own = pc.binary_join(_lists(table.take(self.chunks.flatten()), self.chunks.offsets.to_numpy()), " ")
        filled = np.diff(self.chunks.offsets.to_numpy())[self.index] > 0
        return pc.binary_join(_lists(own.take(pa.array(self.index[filled])), starts(filled)[self.offsets]), " ")

    def ids_text(self) -> pa.Array:
        return self.joined(self.names)

    def decoded(self) -> pa.Array:
        return self.joined(self.tokens)


class WordBpe:
    """Encoder and decoder for one tokenizer file (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((a, b), rank)
        self.matcher = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            key = token.removesuffix(END) + STOP if token.endswith(END) else token
            self.matcher.add_word(key, i)
        self.matcher.make_automaton()
        self.letters = byte_letters()
        self.spelling = np.array([ord(c) for c in self.letters], "<u4")
        self.spelling[ord(" ")] = ord(" ")
        size = max(self.tokens) + 1
        self.spans = np.zeros(size, np.int64)
        for token, i in self.vocab.items():
            self.spans[i] = len(token.removesuffix(END)) + token.endswith(END)
        self.names = pa.array([str(i) for i in range(size)], pa.string())
        self.token_texts = pa.array([self.tokens.get(i, "") for i in range(size)], pa.string())
        self._tables(size)
        self.merged_words = 0

    def _tables(self, size: int) -> None:
        """Arrays of the merge that makes each token, sorted pairs with their ranks, and the tokens that merge to themselves."""
        made = [(r, self.vocab[a], self.vocab[b], self.vocab[a + b]) for (a, b), r in self.merges.items() if a in self.vocab and b in self.vocab and a + b in self.vocab]
        rank, a, b, whole = (np.array(x, np.int64) for x in zip(*made, strict=True)) if made else (np.empty(0, np.int64),) * 4
        order = np.argsort(a << 20 | b)
        self.pair_keys, self.pair_ranks = np.append((a << 20 | b)[order], NEVER), np.append(rank[order], NEVER)
        self.pair_made = np.append(whole[order], 0)
        codes = [ord(c) for c in self.letters]
        self.letter_ids, self.letter_ends = np.zeros(max(codes) + 1, np.int64), np.zeros(max(codes) + 1, np.int64)
        for c in self.letters:
            self.letter_ids[ord(c)], self.letter_ends[ord(c)] = self.vocab[c], self.vocab[c + END]
        self.rank, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        self.alone = np.zeros(size, bool)
        for token, i in self.vocab.items():
            self.alone[i] = len(token.removesuffix(END)) == 1
        each = list(zip(rank.tolist(), a.tolist(), b.tolist(), whole.tolist(), strict=True))
        for r, x, y, t in each:
            if self.rank[t] < 0 and not self.alone[t]:
                self.rank[t], self.left[t], self.right[t] = r, x, y
        for (r, x, y, t), good in zip(each, self.compatible(a, b, rank).tolist(), strict=True):
            if r == self.rank[t]:  # parts are made before the whole
                self.alone[t] = good and self.alone[x] and self.alone[y]

    # exact merging

    def merge(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges: always the lowest rank, leftmost first."""
        n = len(symbols)
        after, before, text = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
        ranks = self.merges
        heap = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if text[i] is None or j >= n or ranks.get((text[i], text[j])) != rank:
                continue
            text[i], text[j] = text[i] + text[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((text[i], text[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((text[h], text[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [t for t in text if t is not None]

    def exact(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of words (in byte letters) by merging alone.

        Words of like length go together, one row each: in every round each row merges its leftmost pair of
        the lowest rank; very long words are merged one by one."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        kinds = np.where(sizes > ROW, ROW + 1, np.where(sizes > 24, -(-sizes // 8) * 8, sizes))
        groups, counts = [], np.zeros(len(words), np.int64)
        for width in np.unique(kinds).tolist():
            rows = np.flatnonzero(kinds == width)
            for at in range(0, len(rows), 1 << 14):
                own = rows[at : at + (1 << 14)]
                some = [words[i] for i in own.tolist()]
                if width > ROW:
                    merged = [[self.vocab[t] for t in self.merge([*w[:-1], w[-1] + END]) if t in self.vocab] for w in some]
                    lengths = np.fromiter(map(len, merged), np.int64, len(merged))
                    flat = np.fromiter(chain.from_iterable(merged), np.int64, int(lengths.sum()))
                else:
                    flat, lengths = self._merge_rows(some, width)
                counts[own] = lengths
                groups.append((own, flat, lengths))
        first = starts(counts)
        out = np.empty(first[-1], np.int64)
        for own, flat, lengths in groups:
            out[np.arange(len(flat)) + np.repeat(first[own] - starts(lengths)[:-1], lengths)] = flat
        return out, counts

    def _merge_rows(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        at = np.arange(width)
        letters = np.frombuffer("".join([w.ljust(width) for w in words]).encode("utf-32-le"), "<u4").reshape(n, width)
        inside = at < sizes[:, None]
        ids = np.where(at == sizes[:, None] - 1, self.letter_ends[letters], self.letter_ids[letters])
        after = np.where(inside & (at + 1 < sizes[:, None]), at + 1, width)
        before = np.where(inside, at - 1, -1)
        ranks = np.full((n, width), NEVER)
        if width > 1:
            ranks[:, :-1] = np.where(inside[:, 1:], self._pair(ids[:, :-1], ids[:, 1:])[0], NEVER)
        rows = np.arange(n)
        while True:
            j = ranks[rows].argmin(axis=1) if len(rows) < n else ranks.argmin(axis=1)
            live = ranks[rows, j] < NEVER
            rows, j = rows[live], j[live]
            if not len(rows):
                break
            k = after[rows, j]
            ids[rows, j] = self._pair(ids[rows, j], ids[rows, k])[1]
            inside[rows, k] = False
            ranks[rows, k] = NEVER
            m = after[rows, j] = after[rows, k]
            right = m < width
            r, c, d = rows[right], j[right], m[right]
            before[r, d] = c
            ranks[rows, j] = NEVER
            ranks[r, c] = self._pair(ids[r, c], ids[r, d])[0]
            h = before[rows, j]
            left = h >= 0
            r, c, d = rows[left], h[left], j[left]
            ranks[r, c] = self._pair(ids[r, c], ids[r, d])[0]
        return ids[inside], inside.sum(axis=1)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NEVER) and result of merging each pair of tokens."""
        keys = a << 20 | b
        at = np.searchsorted(self.pair_keys, keys)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], NEVER), self.pair_made[at]

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the symbols of each pair of tokens merge to that very pair; all pairs are tested together.

        Undoing merges backwards in time shows which two tokens met at the seam when; had they a merge of a
        lower rank than the one undone last (of the same rank: if that one was to the right), it came first."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER) if limit is None else limit.copy()
        good, rest = np.ones(len(a), bool), np.arange(len(a))
        while len(rest):
            x, y = a[rest], b[rest]
            merged = self._pair(x, y)[0] < limit[rest]
            good[rest[merged]] = False
            on_left, on_right = self.rank[x], self.rank[y]
            more = ~merged & (np.maximum(on_left, on_right) >= 0)
            rest, x, y, on_left, on_right = rest[more], x[more], y[more], on_left[more], on_right[more]
            left = on_left > on_right
            limit[rest] = np.where(left, on_left, on_right + 1)
            a[rest], b[rest] = np.where(left, self.right[x], x), np.where(left, y, self.left[y])
        return good

    # speculation and verification

    def greedy(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest-match cuts of all words in one scan: flat ids, the word of each, and which words are covered."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        stops = np.cumsum(sizes)
        found = np.fromiter(chain.from_iterable(self.matcher.iter_long(STOP.join(words) + STOP)), np.int64)
        ends, ids = found[::2], found[1::2]
        spans = self.spans[ids]
        owner = np.searchsorted(stops, ends, side="right")
        return ids, owner, np.bincount(owner, spans, len(words)) == sizes

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of distinct words in byte letters."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        flat, owner, good = self.greedy(words)
        inside = owner[1:] == owner[:-1]
        keys, where = np.unique((flat[:-1] << 20 | flat[1:])[inside], return_inverse=True)
        good[owner[1:][inside][~self.compatible(keys >> 20, keys & 0xFFFFF)[where]]] = False
        good[owner[~self.alone[flat]]] = False
        counts = np.bincount(owner, minlength=len(words))
        failed = np.flatnonzero(~good)
        if not len(failed):
            return flat, counts
        merged, sizes = self.exact([words[i] for i in failed.tolist()])
        self.merged_words += len(failed)
        old = starts(counts)[:-1]
        after = counts.copy()
        after[failed] = sizes
        first = starts(after)
        out = np.empty(first[-1], np.int64)
        kept = good[owner]
        out[(np.arange(len(flat)) + (first[:-1] - old)[owner])[kept]] = flat[kept]
        out[np.arange(sizes.sum()) + np.repeat(first[failed] - starts(sizes)[:-1], sizes)] = merged
        return out, after

    def _spelt(self, words: list[str]) -> list[str]:
        """Words without white space in byte letters, all at once."""
        data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        return self.spelling[data].tobytes().decode("utf-32-le").split(" ") if words else []

    def _cut(self, chunk: str) -> list[str]:
        """Words of one white-space-free chunk; an added token has a space before it."""
        out: list[str] = []
        for part in self.split_added.split(chunk) if self.split_added and "<|" in chunk else (chunk,):
            if part in self.added:
                out.append(" " + part)
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [part] if part.isalpha() else WORDS.findall(part)
        return out

    def _words(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all chunks in order and how many each chunk has; common shapes are cut together."""
        low = pc.utf8_lower(chunks)
        plain = pc.match_substring_regex(chunks, f"^{LETTERS}$").to_numpy(zero_copy_only=False)
        signed = pc.match_substring_regex(chunks, f"^{LETTERS}{SIGN}$").to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~plain & ~signed)
        cuts = [self._cut(c) for c in chunks.take(pa.array(other)).to_pylist()]
        counts = plain + 2 * signed
        counts[other] = [len(c) for c in cuts]
        first = starts(counts)
        words = np.empty(first[-1], object)
        words[first[:-1][plain]] = low.filter(pa.array(plain)).to_numpy(zero_copy_only=False)
        both = low.filter(pa.array(signed))
        words[first[:-1][signed]] = pc.utf8_slice_codeunits(both, 0, -1).to_numpy(zero_copy_only=False)
        words[first[:-1][signed] + 1] = pc.utf8_slice_codeunits(both, -1).to_numpy(zero_copy_only=False)
        for at, cut in zip(first[other].tolist(), cuts, strict=True):
            words[at : at + len(cut)] = cut
        return pa.array(words, pa.string()), counts

    def _chunk_tokens(self, chunks: pa.Array) -> pa.ListArray:
        """The token ids of every distinct chunk."""
        words, counts = self._words(chunks)
        coded = words.dictionary_encode()
        own = ~pc.starts_with(coded.dictionary, " ").to_numpy(zero_copy_only=False)
        flat, sizes = self.learn(self._spelt(coded.dictionary.filter(pa.array(own)).to_pylist()))
        added = [self.added[w[1:]] for w in coded.dictionary.filter(pa.array(~own)).to_pylist()]
        tokens = _lists(pa.array(np.concatenate((flat, np.array(added, np.int64))).astype(np.int32)), starts(np.concatenate((sizes, np.ones(len(added), np.int64)))))
        place = np.empty(len(own), np.int64)
        place[own], place[~own] = np.arange(own.sum()), own.sum() + np.arange(len(added))
        taken = tokens.take(pa.array(place[coded.indices.to_numpy()]))
        return _lists(taken.flatten(), taken.offsets.to_numpy()[starts(counts)])

    def encode_piece(self, texts: pa.Array) -> Encoded:
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring_regex(texts, SEPARATORS)).as_py():
            chunks, index, offsets = coded_words(pa.array([CHUNKS.findall(t) for t in texts.to_pylist()], pa.list_(pa.string())))
        else:
            chunks, index, offsets = white_space_words(texts)
        return Encoded(self._chunk_tokens(chunks), index, offsets, self.names, self.token_texts)

    def encode_batch(self, texts: list[str | None]) -> list[tuple[str, str, int]]:
        """(ids joined by spaces, decoded text, number of tokens) of each text."""
        done = self.encode_piece(pa.array(texts, pa.string()))
        return list(zip(done.ids_text().to_pylist(), done.decoded().to_pylist(), done.sizes().tolist(), strict=True))

    def encode_joined(self, text: str | None) -> tuple[str, str, int]:
        return self.encode_batch([text])[0]

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encode_joined(text)[0].split()]

    def decode(self, ids) -> str:
        """As the library does for a file without a decoder: the tokens joined by spaces, specials kept."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def text(self, ids) -> str:
        """Readable text: byte letters turned back into bytes, word ends into spaces."""
        back = {c: b for b, c in enumerate(self.letters)}
        out = b"".join(t.encode() if (t := self.tokens[i]) in self.added else bytes(back[c] for c in t.removesuffix(END)) + b" " * t.endswith(END) for i in ids)
        return out.decode("utf-8", "replace").rstrip(" ")


_CODECS: dict[int, WordBpe] = {}


def codec(text: str) -> WordBpe:
    """One codec for each tokenizer file and worker process."""
    key = hash(text)
    if key not in _CODECS:
        _CODECS[key] = WordBpe(text)
    return _CODECS[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _sha(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string())


#: Output columns: type and how they come from an encoded piece.
OUTPUTS = {
    "ids": ("array<int>", lambda done: done.ids()),
    "decoded": ("string", lambda done: done.decoded()),
    "ids_sha256": ("string", lambda done: _sha(done.ids_text())),
    "decoded_sha256": ("string", lambda done: _sha(done.decoded())),
}


def encode_documents(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``doc_id, n_tokens`` and the named :data:`OUTPUTS` for every row of ``docs``.

    One narrow pass: the file's text (a few MB) is broadcast; a worker keeps its tables alone, no words."""
    file = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches):
        bpe = codec(file.value)
        for batch in batches:
            for part in pieces(batch, 1):
                done = bpe.encode_piece(part.column(1))
                own = [OUTPUTS[name][1](done) for name in outputs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done.sizes(), pa.int64()), *own], names=["doc_id", "n_tokens", *outputs])

    schema = ", ".join(["doc_id long", "n_tokens long", *(f"{name} {OUTPUTS[name][0]}" for name in outputs)])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
