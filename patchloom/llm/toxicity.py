"""Toxicity by maximum-scoring segments of token log-odds.

Fit: tokens (words, and their stems of five letters) fall into a fixed number of hash buckets. Counts of
toxic and clean labelled documents are compared under a Dirichlet prior proportional to the counts of
the whole corpus, which gives each bucket a shrunken log-odds score; a constant drift makes ordinary text
score below zero. Scan: one linear pass (Ruzzo and Tompa) finds all maximal-scoring segments of a text.
Calibration: the best segments of clean labelled documents follow an extreme-value law with a rate and a
size constant; a segment's excess over what its document's length would reach by chance is its evidence,
the excesses of all significant segments are summed, and a logistic curve fitted on labelled documents
turns the sum into a score.

The labelled rows are a sample of at most ``limit`` ids (by a hash of the id, fold 0 left out); the
corpus counts cover every document. Inputs of a score are the text alone.

Defined cases: null and empty texts have no segment and get the score of no evidence; texts are scanned
whole; repeated rows are scored each; a null doc_id is scored and held out is null; without labelled rows
of both kinds every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.batches import pieces, starts, white_space_words
from patchloom.llm.training import fold, labelled_sample, labelled_texts
from patchloom.storage import materialize

WORD_BITS, STEM_BITS, STEM = 17, 15, 5
EDGE = string.punctuation + "«»“”„’‘…¿¡"


def chunk_codes(chunks: pa.Array) -> np.ndarray:
    """Word bucket and stem bucket in one integer for each chunk of text between white space; -1 for signs alone."""
    words = [c.lower().strip(EDGE) for c in chunks.to_pylist()]
    word_mask, stem_mask, crc = (1 << WORD_BITS) - 1, (1 << STEM_BITS) - 1, zlib.crc32
    found = ((crc(w.encode("utf-8", "surrogatepass")) & word_mask) << STEM_BITS | crc(w[:STEM].encode("utf-8", "surrogatepass"), 1) & stem_mask if w else -1 for w in words)
    return np.fromiter(found, np.int64, len(words))


def text_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of all texts in order, and the offsets of the texts among them."""
    chunks, index, offsets = white_space_words(texts)
    codes = chunk_codes(chunks)[index]
    real = codes >= 0
    return codes[real], starts(real)[offsets]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) in linear time; runs of positive scores first."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    cut = np.flatnonzero(np.diff(up) > 1)
    starts, ends = up[np.concatenate(([0], cut + 1))], up[np.concatenate((cut, [len(up) - 1]))] + 1
    held: list[list] = []  # [left sum, right sum, start, end, index of the nearest earlier one with a smaller left sum]
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        new = [float(total[start]), float(total[end]), start, end, -1]
        at = len(held) - 1
        while True:
            while at >= 0 and held[at][0] >= new[0]:
                at = held[at][4]
            if at < 0 or held[at][1] >= new[1]:
                new[4] = at
                held.append(new)
                break
            new[0], new[2] = held[at][0], held[at][2]
            link = held[at][4]
            del held[at:]
            at = link
    return [(r - left, a, b) for left, r, a, b, _ in held]


@dataclass
class ToxicityModel:
    words: np.ndarray
    stems: np.ndarray
    rate: float = 1.0
    size: float = 1.0
    slope: float = 1.0
    base: float = -2.0
    chance: float = 0.01
    usable: bool = True

    def token_scores(self, codes: np.ndarray) -> np.ndarray:
        scores = self.words[codes >> STEM_BITS] + self.stems[codes & ((1 << STEM_BITS) - 1)]
        again = np.flatnonzero(codes[1:] == codes[:-1]) + 1
        scores[again] = np.minimum(scores[again], 0.0)  # a word said again at once is no new evidence
        return scores

    def scanned(self, texts: pa.Array):
        """The number of words and the maximal segments of each text."""
        codes, offsets = text_codes(texts)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield b - a, segments(self.token_scores(codes[a:b]))

    def excess(self, score, n: int):
        """Evidence of a segment of a text of n tokens: above 0 if chance gives it with less than ``chance``."""
        return self.rate * score - math.log(max(self.size * max(n, 1), 1.0) / self.chance)

    def evidence(self, found: list, n: int) -> float:
        return sum(x for s, *_ in found if (x := self.excess(s, n)) > 0)

    def probability(self, evidence: float) -> float:
        if not self.usable:
            return 0.0
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, self.slope * math.log1p(evidence) + self.base))))


def _counts(docs: DataFrame, labelled: DataFrame) -> np.ndarray:
    """Rows corpus, toxic and clean of token counts by bucket (words, then stems): occurrences in every document, and presence
    in the labelled texts, one for each labelled id."""
    size = (1 << WORD_BITS) + (1 << STEM_BITS)
    rows = docs.select("text", F.lit(None).cast("int").alias("y")).unionByName(labelled.select("text", "y"))

    def both(codes):
        return np.concatenate((codes >> STEM_BITS, (codes & ((1 << STEM_BITS) - 1)) + (1 << WORD_BITS)))

    def run(batches):
        total = np.zeros((3, size), np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                codes, offsets = text_codes(part.column(0))
                labels = pc.fill_null(part.column(1), -1).to_numpy()
                total[0] += np.bincount(both(codes[np.repeat(labels < 0, np.diff(offsets))]), minlength=size)
                for i in np.flatnonzero(labels >= 0).tolist():
                    # presence, not frequency: one rant must not stand for the language
                    total[2 - labels[i]][np.unique(both(codes[offsets[i] : offsets[i + 1]]))] += 1
        at = np.flatnonzero(total.any(axis=0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)], names=["bucket", "corpus", "toxic", "clean"])

    parts = rows.mapInArrow(run, "bucket long, corpus long, toxic long, clean long")
    table = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("corpus", "toxic", "clean")]).toArrow()
    out = np.zeros((3, size))
    out[:, table.column(0).to_numpy()] = [table.column(i).to_numpy() for i in (1, 2, 3)]
    return out


def log_odds(corpus: np.ndarray, toxic: np.ndarray, clean: np.ndarray, prior: float) -> np.ndarray:
    """Log-odds with a Dirichlet prior of total weight ``prior`` spread like the corpus, shrunk by its error."""
    alpha = prior * (corpus + 0.5) / (corpus.sum() + 0.5 * len(corpus))
    a, b = toxic.sum() + prior, clean.sum() + prior
    y, n = toxic + alpha, clean + alpha
    delta = np.log(y / (a - y)) - np.log(n / (b - n))
    error = np.sqrt(1 / y + 1 / n)
    return np.sign(delta) * np.maximum(np.abs(delta) - 0.5 * error, 0)


def _gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Rate and size constant of the best chance segments, by maximum likelihood."""
    def gap(rate):
        w = n * np.exp(-rate * best)
        return 1 / rate - best.mean() + (best * w).sum() / w.sum()

    low, high = 0.05, 5.0
    if gap(high) > 0:
        rate = high
    elif gap(low) < 0:
        rate = low
    else:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if gap(mid) > 0 else (low, mid)
        rate = (low + high) / 2
    return rate, len(best) / float((n * np.exp(-rate * best)).sum())


def fit(docs: DataFrame, labels: DataFrame, limit: int = 20_000, prior: float = 2000.0, drift: float = 0.6) -> ToxicityModel:
    """The model; ``limit`` bounds the labelled ids it learns from."""
    labelled = materialize(labelled_texts(docs, labelled_sample(labels, "toxic", limit)).select("label_id", "text", "y"), "labelled-texts")
    corpus, toxic, clean = _counts(docs, labelled)
    cut = 1 << WORD_BITS
    words = log_odds(corpus[:cut], toxic[:cut], clean[:cut], prior)
    stems = log_odds(corpus[cut:], toxic[cut:], clean[cut:], prior)
    model = ToxicityModel(np.clip(words, -2, 4) / 2 - drift / 2, np.clip(stems, -2, 4) / 2 - drift / 2)

    def scan(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                found = list(model.scanned(part.column(1)))
                scores = [sorted((s for s, *_ in f), reverse=True) for _, f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([n for n, _ in found], pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["label_id", "y", "n", "s"])

    # in the order of the ids, so that sums do not depend on which task ended first
    rows = labelled.mapInArrow(scan, "label_id long, y int, n long, s array<double>").toArrow().sort_by("label_id").to_pydict()
    y, n = np.array(rows["y"], float), np.array(rows["n"], float)
    if not len(y) or y.min() == y.max():
        model.usable = False
        return model
    best = np.array([s[0] if s else 0.0 for s in rows["s"]])
    quiet = (y == 0) & (n > 0)
    model.rate, model.size = _gumbel(best[quiet], n[quiet])
    x = np.log1p([model.evidence([(v,) for v in s], int(k)) for s, k in zip(rows["s"], n, strict=True)])
    w = np.zeros(2)
    features = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):  # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(features @ w, -60, 60)))
        hessian = features.T @ (features * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w += np.linalg.solve(hessian, features.T @ (y - p) - 1e-3 * w)
    model.slope, model.base = float(w[0]), float(w[1])
    return model


def toxic_passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, passages``: every significant passage as (start, end, score, evidence) in words with a letter or digit."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())]))
        for batch in batches:
            for part in pieces(batch, 1):
                scores, spans = [], []
                for n, found in own.scanned(part.column(1)):
                    scores.append(own.probability(own.evidence(found, n)))
                    spans.append([{"start": a, "end": b, "score": s, "evidence": x} for s, a, b in found if (x := own.excess(s, n)) > 0])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "passages"])

    schema = "doc_id long, score double, passages array<struct<start: long, end: long, score: double, evidence: double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages`` for every row of ``docs``."""
    found = toxic_passages(docs, fit(docs, labels, limit))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", predicted, F.size("passages").cast("long").alias("n_passages"))


def keep_clean(docs: DataFrame, labels: DataFrame, limit: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score stays below ``threshold``; one narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))
    at = docs.columns.index("text")

    def run(batches):
        own = held.value
        for batch in batches:
            for part in pieces(batch, at):
                yield part.filter(pa.array([own.probability(own.evidence(found, n)) < threshold for n, found in own.scanned(part.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
