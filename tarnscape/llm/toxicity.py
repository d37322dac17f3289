"""Toxicity by a factorization machine over hashed terms."""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnscape.llm.memo import Memo

BUCKETS = 1 << 18
FACTORS = 4
#: Penalties: L1 on linear weights for each row of the sample (tried in turn, see tuned), and on the length of a factor vector for each step.
L1_SHARES, V_SHRINK = (1 / 1000, 1 / 500, 1 / 250), 0.05
#: Terms whose pairs are screened for factors, the most frequent ones; a pair tells something beyond so many deviations.
SCREENED, BEYOND = 1500, 5.0
_TERM = re.compile(r"[^\W\d_]+")


#: Lengths of word beginnings that are terms too, so that inflected forms share one.
STEMS = (4, 5, 6, 7)


def _buckets(word: str) -> tuple[int, ...]:
    parts = [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)


def terms(text: str | None, memo: Memo) -> list[int]:
    """Sorted hash buckets of the distinct words and word beginnings of a whole text, in lower case.

    ``memo`` gives the buckets of a word: all of them (_buckets) or those a model knows."""
    if not text:
        return []
    out: set[int] = set()
    for found in map(memo.__getitem__, set(_TERM.findall(text.lower()))):
        if found:
            out.update(found)
    return sorted(out)


class Machine:
    """score = sigmoid(w0 + sum of w + half of (|sum of v|^2 - sum of |v|^2)) over the terms present.

    Presence counts, not frequency, so one insult weighs as much in a long text as in a short
    one. Linear weights come first, by FTRL with an L1 penalty that leaves most terms at
    zero; then terms that tell something get factors, by AdaGrad with a shrinkage of whole
    vectors, while linear weights go on. These are the terms left, and those of pairs that
    explain what the linear weights leave (_paired): a term that is neutral on its own may
    tell something in a pair. The rest can't be memorized by factors."""

    def __init__(self, docs: list, y: np.ndarray, epochs: int = 5, batch: int = 128, seed: int = 11, share: float = L1_SHARES[1]):
        # the penalty on linear weights grows with the sample, as sums of gradients do
        l1 = max(0.5, len(docs) * share)
        seen, count = np.unique(np.concatenate([*docs, np.empty(0, np.int32)]), return_counts=True)
        seen = seen[count >= max(2, len(docs) // 1000)]
        place = np.full(BUCKETS, -1, np.int32)
        place[seen] = np.arange(len(seen))
        rows = [place[np.asarray(d, np.int32)] for d in docs]
        rows = [r[r >= 0] for r in rows]
        rng = np.random.default_rng(seed)
        n = len(seen)
        z, s, w = np.zeros(n), np.zeros(n), np.zeros(n)
        v, g2 = np.zeros((n, FACTORS)), np.full((n, FACTORS), 1e-2)
        w0, g0 = 0.0, 1e-2
        live = rows
        for epoch in range(2 * epochs):
            pairs = epoch >= epochs
            if epoch == epochs:
                chosen = (w != 0) | _paired(rows, y, w0 + np.array([w[r].sum() for r in rows]), n)
                v[chosen] = rng.normal(0, 0.05, (int(chosen.sum()), FACTORS))
                live = [r[chosen[r]] for r in rows]
            for pick in np.array_split(rng.permutation(len(live)), max(1, len(live) // batch)):
                if not len(pick):
                    continue
                cat = np.concatenate([live[i] for i in pick])
                row = np.repeat(np.arange(len(pick)), [len(live[i]) for i in pick])
                raw = w0 + np.bincount(row, w[cat], len(pick))
                if pairs:
                    total = np.stack([np.bincount(row, v[cat, f], len(pick)) for f in range(FACTORS)], 1)
                    raw += 0.5 * ((total**2).sum(1) - np.bincount(row, (v[cat] ** 2).sum(1), len(pick)))
                e = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]
                g0 += e.sum() ** 2
                w0 -= 0.2 * e.sum() / np.sqrt(g0)
                used, back = np.unique(cat, return_inverse=True)
                gw = np.bincount(back, e[row], len(used))
                root = np.sqrt(s[used] + gw**2)
                z[used] += gw - (root - np.sqrt(s[used])) / 0.15 * w[used]
                s[used] += gw**2
                w[used] = np.where(np.abs(z[used]) <= l1, 0, -(z[used] - np.sign(z[used]) * l1) / (1e-3 + (1 + np.sqrt(s[used])) / 0.15))
                if pairs:
                    pull = e[row, None] * (total[row] - v[cat])
                    gv = np.stack([np.bincount(back, pull[:, f], len(used)) for f in range(FACTORS)], 1)
                    g2[used] += gv**2
                    step = 0.05 / np.sqrt(g2[used])
                    v[used] -= step * gv
                    size = np.linalg.norm(v[used], axis=1, keepdims=True)
                    v[used] *= np.maximum(0, 1 - step.mean(1, keepdims=True) * V_SHRINK / np.maximum(size, 1e-9))
        keep = (w != 0) | (np.linalg.norm(v, axis=1) > 1e-6)
        self.w0, self.w, self.v = w0, w[keep], v[keep]
        self.place = {int(b): i for i, b in enumerate(seen[keep])}
        at = np.where(keep, np.cumsum(keep) - 1, -1)
        raw = np.array([self._sum(np.array([i for i in at[r] if i >= 0], np.int64)) for r in rows])
        self.w0 -= _best_cut(raw, y)

    def _sum(self, at: np.ndarray) -> float:
        v = self.v[at]
        return self.w0 + float(self.w[at].sum()) + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())

    def raw(self, buckets: list[int]) -> float:
        return self._sum(np.array([i for i in map(self.place.get, buckets) if i is not None], np.int64))

    def score(self, buckets: list[int]) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.raw(buckets), -30, 30))))


def _paired(rows: list, y: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """Which terms are in a pair that explains the residual of the linear scores ``raw``.

    Of the SCREENED most frequent terms, the sum of residuals over the texts with both terms
    is compared with its deviation by chance; all pairs come from one matrix product."""
    out = np.zeros(n, bool)
    if not rows or not n:
        return out
    count = np.bincount(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), minlength=n)
    top = np.sort(np.argsort(-count, kind="stable")[:SCREENED])
    at = np.full(n, -1)
    at[top] = np.arange(len(top))
    left = y - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
    total, spread = np.zeros((len(top), len(top)), np.float32), np.zeros((len(top), len(top)), np.float32)
    for lo in range(0, len(rows), 2048):
        part = rows[lo : lo + 2048]
        x = np.zeros((len(part), len(top)), np.float32)
        for i, r in enumerate(part):
            x[i, at[r][at[r] >= 0]] = 1
        res = left[lo : lo + 2048].astype(np.float32)
        total += x.T @ (x * res[:, None])
        spread += x.T @ (x * res[:, None] ** 2)
    z = np.abs(total) / np.sqrt(np.maximum(spread, 1.0))
    np.fill_diagonal(z, 0)
    out[top[(z > BEYOND).any(1)]] = True
    return out


def tuned(docs: list, y: np.ndarray, aside: np.ndarray) -> Machine:
    """The machine with the L1 penalty that does best (F1) on the rows ``aside`` when learned from the others, then learned from all."""
    best, share = -1.0, L1_SHARES[1]
    if aside.any() and not aside.all():
        for s in L1_SHARES:
            m = Machine([d for d, a in zip(docs, aside, strict=True) if not a], y[~aside], share=s)
            told = np.array([m.raw(list(d)) >= 0 for d, a in zip(docs, aside, strict=True) if a])
            f1 = 2 * (told & (y[aside] > 0)).sum() / max(1, told.sum() + (y[aside] > 0).sum())
            if f1 > best:
                best, share = f1, s
    return Machine(docs, y, share=share)


def _best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The margin with the best F1 on the sample: midway between neighbours, so 0.5 means that cut."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(-raw, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    after = raw[order[k + 1]] if k + 1 < len(y) else raw[order[k]] - 2
    return float((raw[order[k]] + after) / 2)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> Machine:
    """Fit on at most ``max_rows`` labelled documents, the first by a hash of doc_id.

    Learns only from rows whose crc32(doc_id) mod 5 isn't 0; those with remainder 4 choose
    the penalty. Rows that share a doc_id share the larger label and count as one text, the
    first by its terms; rows without label or text don't count."""
    known = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("toxic").isNotNull())
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def make(batches):
        memo = Memo(_buckets)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["toxic"].astype("int64"), "x": [np.array(terms(t, memo), np.int32).tobytes() for t in b["text"]]})

    one = rows.mapInPandas(make, "doc_id long, y long, x binary").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x"))
    got = one.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5).toPandas().sort_values("doc_id")
    return tuned([np.frombuffer(x, np.int32) for x in got["x"]], got["y"].to_numpy(float).clip(0, 1), got["fold"].to_numpy() == 4)


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """All columns of docs, with toxic_score of each whole text; null texts score as empty ones.

    A column of that name in docs is replaced.

    The model has at most BUCKETS terms, whatever the size of the data, so it may be broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        memo = Memo(lambda w: tuple(b for b in _buckets(w) if b in m.place))
        for b in batches:
            yield pd.Series([m.score(terms(t, memo)) for t in b], dtype="float64")

    return docs.withColumn("toxic_score", score.asNondeterministic()("text"))
