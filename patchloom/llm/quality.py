"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes that cover its whole text. Each passage is encoded
from the frequencies of its character classes and their neighbours; gated attention weighs the passages
(softmax of w·(tanh(V h) * sigmoid(U h))) and the weighted mean is scored by a logistic unit. Only whole
documents have labels; the attention weights are learnt from them. The network is small, fitted on the
driver by Adam on a sample of at most ``limit`` labelled ids (by a hash of the id, fold 0 left out) and ``most``
passages of each, and broadcast; scoring is one narrow pass over all documents and their whole texts, in runs
of passages, so memory does not grow with a text's length.

Defined cases: null and empty texts are one passage without characters; repeated rows are scored each; a
null doc_id is scored and held out is null; without labelled rows of both kinds the score is the share of
label 1 (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.batches import pieces
from patchloom.llm.training import fold, labelled_sample, labelled_texts

PASSAGE, HIDDEN, ATTENTION = 1024, 24, 12
#: Passages whose features are held at a time.
RUN = 512
SIGNS = b" \n.,!?:;-'\"|$%&*#@=/()"
CLASSES = len(SIGNS) + 6


def _class_table() -> np.ndarray:
    table = np.full(256, len(SIGNS) + 5, np.int64)  # other signs and controls
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = range_of(0), range_of(1), range_of(2)
    table[0x80:0xC0], table[0xC0:] = range_of(3), range_of(4)
    for i, c in enumerate(SIGNS):
        table[c] = i
    return table


def range_of(kind: int) -> int:
    return len(SIGNS) + kind


TABLE = _class_table()
WIDTH = CLASSES * CLASSES + CLASSES


def features(data: bytes, before: bytes = b"") -> np.ndarray:
    """(number of passages, WIDTH) float32 features of bytes that start a passage; ``before`` is the byte ahead of them, if any."""
    n = max(1, -(-len(data) // PASSAGE))
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    kinds = TABLE[np.frombuffer(before + data, np.uint8)]
    own = kinds[len(before) :]
    where = np.arange(len(own)) // PASSAGE
    paired = where if before else where[1:]
    pairs = np.bincount(paired * CLASSES * CLASSES + kinds[:-1] * CLASSES + kinds[1:], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    single = np.bincount(where * CLASSES + own, minlength=n * CLASSES).reshape(n, -1)
    length = np.bincount(where, minlength=n)[:, None]
    out[:, : CLASSES * CLASSES] = np.sqrt(pairs / length)
    out[:, CLASSES * CLASSES :] = np.sqrt(single / length)
    return out


def passages(text: str | None) -> np.ndarray:
    """The features of all passages of a text."""
    return features((text or "").encode("utf-8", "surrogatepass"))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionMil:
    """Gated-attention multiple-instance network with its gradient."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "E": r.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)) * 4, "e": np.zeros(HIDDEN),
            "V": r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, ATTENTION)), "U": r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, ATTENTION)),
            "w": r.normal(0, 1 / np.sqrt(ATTENTION), ATTENTION), "c": np.zeros(HIDDEN), "b": np.zeros(1),
        }
        self.constant: float | None = None

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raw = (t * g) @ p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, raw)
        a = np.exp(raw - top[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = np.zeros((n, HIDDEN))
        np.add.at(z, bag, a[:, None] * h)
        return h, t, g, a, z, _sigmoid(z @ p["c"] + p["b"][0])

    def gradient(self, x, bag, y):
        p, n = self.p, len(y)
        h, t, g, a, z, s = self.forward(x, bag, n)
        d = (s - y) / n
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        draw = a * (da - np.bincount(bag, a * da, n)[bag])
        dt, dg = draw[:, None] * p["w"] * g * (1 - t * t), draw[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ draw, "c": z.T @ d, "b": np.array([d.sum()])}

    def train(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 7):
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                x = np.concatenate([bags[i] for i in rows]).astype(np.float64)
                bag = np.repeat(np.arange(len(rows)), [len(bags[i]) for i in rows])
                step += 1
                lr = rate * (1 - epoch / epochs)
                for k, d in self.gradient(x, bag, y[rows]).items():
                    d = d + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def long_score(self, data: bytes) -> float:
        """The score of one text in runs of passages: the largest raw attention so far, the sums under it, and nothing else."""
        p, top, total, z = self.p, -np.inf, 0.0, np.zeros(HIDDEN)
        for at in range(0, max(1, len(data)), RUN * PASSAGE):
            h = np.tanh(features(data[at : at + RUN * PASSAGE], data[at - 1 : at] if at else b"") @ p["E"] + p["e"])
            raw = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
            high = max(top, float(raw.max()))
            a, old = np.exp(raw - high), np.exp(top - high)
            top, total, z = high, total * old + a.sum(), z * old + a @ h
        return float(_sigmoid(z / total @ p["c"] + p["b"][0]))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts; short ones together, long ones alone, never more than ``RUN`` passages or one short text more."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, held, size = np.empty(len(texts)), [], 0
        encoded = ((t or "").encode("utf-8", "surrogatepass") for t in texts)

        def flush():
            if held:
                bags = [features(d) for _, d in held]
                bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
                out[[i for i, _ in held]] = self.forward(np.concatenate(bags), bag, len(bags))[-1]
                held.clear()

        for i, data in enumerate(encoded):
            if len(data) > RUN * PASSAGE:
                out[i] = self.long_score(data)
                continue
            if size + len(data) + PASSAGE > RUN * PASSAGE:
                flush()
                size = 0
            held.append((i, data))
            size += max(PASSAGE, len(data))
        flush()
        return out


def spread_passages(text: str | None, most: int) -> np.ndarray:
    """The features of all passages of a text; of more than ``most`` passages, means over ``most`` even runs of them.

    Every passage counts, and no more than ``RUN`` passages' features are held beside the means."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, -(-len(data) // PASSAGE))
    if n <= most:
        return features(data)
    total, seen = np.zeros((most, WIDTH)), np.zeros(most)
    for at in range(0, n, RUN):
        a = at * PASSAGE
        part = features(data[a : a + RUN * PASSAGE], data[a - 1 : a] if a else b"")
        run = np.arange(at, at + len(part)) * most // n
        np.add.at(total, run, part)
        seen += np.bincount(run, minlength=most)
    return (total / seen[:, None]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, limit: int = 3_000, most: int = 64) -> AttentionMil:
    """The network; ``limit`` bounds the labelled ids it learns from. A text of more than ``most`` passages is learnt as ``most``
    means over runs of them, so that the bags of the sample stay bounded while whole texts count."""
    sample = labelled_sample(labels, "quality", limit)
    own = labelled_texts(docs, sample).select("label_id", "y", "text")

    def encode(batches):
        for batch in batches:
            bags = [spread_passages(t.as_py(), most).astype(np.float16).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["label_id", "y", "bag"])

    rows = own.mapInArrow(encode, "label_id long, y int, bag binary").toArrow().sort_by([("label_id", "ascending")])
    y = np.array(rows.column("y").to_pylist(), float)
    net = AttentionMil()
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    bags = [np.frombuffer(b.as_buffer(), np.float16).reshape(-1, WIDTH) for b in rows.column("bag")]
    return net.train(bags, y)


def quality(docs: DataFrame, labels: DataFrame, limit: int = 3_000, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
