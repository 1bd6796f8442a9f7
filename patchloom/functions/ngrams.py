"""Word runs of one pair, counted inside its row, so that no run leaves the task that holds the pair's words."""

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``matched, own, asked``: an entry for each size of runs. ``key_matched, key_asked``: single words that are keywords.
#: ``found``: words of the references that the hypothesis has at all.
SHARED = "struct<matched: array<bigint>, own: array<bigint>, asked: array<bigint>, key_matched: bigint, key_asked: bigint, found: bigint>"


def runs(words: list, n: int) -> list[str]:
    """All runs of n words, space-joined; a null word is empty alone and left out beside others."""
    if n == 1 and None not in words:
        return words
    parts = zip(*(words[i:] for i in range(n)))
    return [" ".join(w for w in p if w is not None) for p in parts] if None in words else list(map(" ".join, parts))


def shared_runs(hyp: list | None, refs: list | None, most: int, keywords=()) -> dict:
    """How many runs of the hypothesis one reference has (clipped by the one that has a run most often), has itself, and are asked for."""
    matched, own, asked, at_keys, found = [], [], [], (0, 0), 0
    for n in range(1, most + 1):
        h, r = Counter(runs(hyp or [], n)), Counter()
        for words in refs or []:
            r |= Counter(runs(words or [], n))
        both = h & r
        matched.append(both.total())
        own.append(h.total())
        asked.append(r.total())
        if n == 1:
            at_keys = sum(both[w] for w in keywords), sum(r[w] for w in keywords)
            found = sum(c for w, c in r.items() if w in h)
    return {"matched": matched, "own": own, "asked": asked, "key_matched": at_keys[0], "key_asked": at_keys[1], "found": found}


def shared(hyp: Column, refs: Column, most: int, keywords=()) -> Column:
    """Arrow UDF of :func:`shared_runs`, one row's words at a time; made on use, since modules are also imported where no session exists."""
    keywords = tuple(dict.fromkeys(keywords))

    def batch(h, r):
        import pyarrow as pa

        sizes = pa.list_(pa.int64())
        kind = pa.struct([("matched", sizes), ("own", sizes), ("asked", sizes), ("key_matched", pa.int64()), ("key_asked", pa.int64()), ("found", pa.int64())])
        return pa.array([shared_runs(h[i].as_py(), r[i].as_py(), most, keywords) for i in range(len(h))], kind)

    batch.__annotations__ = {}
    return F.arrow_udf(batch, SHARED)(hyp, refs)
