"""Language identification: the family first, then one-versus-one SVMs among its languages."""

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: ISO 639-1 codes by family. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "turkic": "az kk tr uz",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
#: Hashed features: counts of runs of 1, 2 and 3 characters.
DIMS = 1 << 12
_LETTER: list = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def features(text: str | None, block: int = 1 << 20) -> np.ndarray | None:
    """Square roots of hashed n-gram counts of a whole text, of length 1; None without letters.

    Anything but a letter counts as a blank and runs of blanks as one. Long texts go in
    blocks that overlap by two characters, so memory is bounded and no n-gram is lost."""
    if not text:
        return None
    total, any_letter, tail = np.zeros(DIMS), False, np.empty(0, np.uint32)
    for at in range(0, len(text), block):
        c = np.frombuffer(text[at : at + block].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(letters()[c], c, np.uint32(32))
        any_letter = any_letter or bool((c != 32).any())
        c = np.concatenate([tail, c])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        h = np.zeros(len(c), np.uint32)
        for n in range(1, 4):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]
            new = h[max(0, len(tail) - n + 1) :] if at else h
            total += np.bincount(((new * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) >> np.uint32(20), minlength=DIMS)
        tail = c[-2:]
    if not any_letter:
        return None
    x = np.sqrt(total)
    return (x / np.linalg.norm(x)).astype(np.float32)


def alphabet(text: str) -> str:
    """The distinct letters of a text, in lower case."""
    c = np.unique(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32))
    return "".join(map(chr, c[letters()[c]]))


def known_share(text: str, known: np.ndarray, block: int = 1 << 20) -> float:
    """The share of a text's letters that are ``known`` (a flag for each code point)."""
    some = total = 0
    for at in range(0, len(text), block):
        c = np.frombuffer(text[at : at + block].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        total += int(letters()[c].sum())
        some += int(known[c].sum())
    return some / max(1, total)


def _svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float, float, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps, then a sigmoid on its margins.

    Both classes weigh the same. Gives weights, bias, and slope and offset of the sigmoid."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    w, v = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    rate = np.float32(1 / (2 * 2 + 2 * reg))
    for k in range(steps):
        pull = weight * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        grad = -2 * np.append(pull @ x, pull.sum()) + np.float32(2 * reg) * v
        fresh = v - rate * grad
        v = fresh + np.float32(k / (k + 3)) * (fresh - w)
        w = fresh
    m, a, b = (x @ w[:-1] + w[-1]).astype(float), 2.0, 0.0
    for _ in range(200):  # sigmoid, held near the margins' own scale
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = weight * (p - (y > 0))
        a, b = float(np.clip(a - 2 * (g @ m), 0.5, 12)), b - 2 * g.sum()
    return w[:-1].astype(np.float32), float(w[-1]), a, b


def _softmax(x: np.ndarray, at: np.ndarray, classes: int, reg: float = 1e-4, steps: int = 150, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by accelerated gradient steps over batches in turn; all classes weigh the same."""
    w = v = np.zeros((x.shape[1] + 1, classes), np.float32)
    weight = (1 / np.maximum(1, np.bincount(at, minlength=classes)))[at].astype(np.float32)
    order = np.random.default_rng(3).permutation(len(x))
    rate = np.float32(8.0)
    for k in range(steps):
        pick = order if len(order) <= batch else order.take(range(k * batch, (k + 1) * batch), mode="wrap")
        part, own, share = x[pick], at[pick], weight[pick] / weight[pick].sum()
        raw = part @ v[:-1] + v[-1]
        p = np.exp(raw - raw.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(own)), own] -= 1
        p *= share[:, None]
        fresh = v - rate * (np.concatenate([part.T @ p, p.sum(0, keepdims=True)]) + np.float32(reg) * v)
        v = fresh + np.float32(k / (k + 3)) * (fresh - w)
        w = fresh
    return w[:-1], w[-1]


class Model:
    """One softmax over families, then SVMs for each pair of a family's languages.

    The size is DIMS weights for each family and each pair in a family."""

    def __init__(self, x: np.ndarray, lang: list[str], alphabets: list[str] = ()):
        self.langs = sorted(set(lang))
        # letters of one text in a thousand at least, and of two
        seen = Counter("".join(alphabets))
        self.letters = sorted(ord(c) for c, n in seen.items() if n >= max(min(2, len(x)), len(x) // 1000))
        index = {v: i for i, v in enumerate(self.langs)}
        at = np.array([index[v] for v in lang])
        self.family = [FAMILY_OF.get(v.split("-")[0].lower(), v) for v in self.langs]
        self.families = sorted(set(self.family))
        self.members = [[i for i, v in enumerate(self.family) if v == f] for f in self.families]
        number = {f: i for i, f in enumerate(self.families)}
        self.fw, self.fb = _softmax(x, np.array([number[self.family[i]] for i in at]), len(self.families))
        self.pairs = [(f, i, j) for f, m in enumerate(self.members) for i, j in combinations(range(len(m)), 2)]
        rows = []
        for f, i, j in self.pairs:
            p, q = self.members[f][i], self.members[f][j]
            pick = (at == p) | (at == q)
            rows.append(_svm(x[pick], np.where(at[pick] == p, 1.0, -1.0)))
        self.w = np.array([r[0] for r in rows], np.float32).reshape(len(rows), DIMS)
        self.rest = np.array([r[1:] for r in rows]).reshape(len(rows), 3)

    def _vote(self, prob: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
        """The member with most wins (ties: larger summed probability, then order), and its weakest win."""
        n, many = prob.shape[0], len(self.members[family])
        wins, total, least = np.zeros((n, many)), np.zeros((n, many)), np.ones((n, many))
        for k, (f, i, j) in enumerate(self.pairs):
            if f == family:
                for side, chance in ((i, prob[:, k]), (j, 1 - prob[:, k])):
                    wins[:, side] += chance >= 0.5
                    total[:, side] += chance
                    least[:, side] = np.minimum(least[:, side], chance)
        best = (wins + total / (1 + many)).argmax(1)
        return best, least[np.arange(n), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        raw = x @ self.fw + self.fb
        chance = np.exp(raw - raw.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        fam = chance.argmax(1)
        prob = 1 / (1 + np.exp(-np.clip((x @ self.w.T + self.rest[:, 0]) * self.rest[:, 1] + self.rest[:, 2], -30, 30)))
        out, score = [""] * len(x), np.zeros(len(x))
        for f in np.unique(fam).tolist():
            rows = np.nonzero(fam == f)[0]
            lang, s = self._vote(prob[rows], f)
            for r, m, p in zip(rows, lang, s, strict=True):
                out[r], score[r] = self.langs[self.members[f][m]], float(chance[r, f]) * p
        return out, score


def train(docs: DataFrame, per_lang: int = 400, max_rows: int = 4_000) -> Model | None:
    """Fit on at most ``per_lang`` texts of each language, fewer where all would be more than ``max_rows``, but on one of each at least.

    Learns from text and non-null lang of documents whose crc32(doc_id) mod 3 isn't 1. The
    sample is the first of each language by a hash of doc_id, so reruns agree: rows are
    counted by language, hashes above the share that gives about twice the sample are left
    out, and only the rest is ranked, so no task gets all rows of a language. Rows that share
    doc_id and lang count once."""
    learn = docs.where((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not counts:
        return None
    per_lang = max(1, min(per_lang, max_rows // len(counts)))
    spark = docs.sparkSession
    want = 2 * per_lang + 30  # so many that fewer than per_lang practically never come
    shares = spark.createDataFrame([(v, want / n if n > want else 1.1) for v, n in counts.items()], "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / float(2**63)
    some = learn.select("lang", "doc_id").withColumn("place", place).join(F.broadcast(shares), "lang").where("place < share").groupBy("lang", "doc_id").agg(F.min("place").alias("place"))
    ids = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).where(F.col("r") <= per_lang)
    picked = learn.join(F.broadcast(ids.select("lang", "doc_id")), ["lang", "doc_id"], "left_semi").select("doc_id", "lang", "text")

    def make(batches):
        for b in batches:
            f = [features(t) for t in b["text"]]
            yield pd.DataFrame([(d, v, x.astype(np.float16).tobytes(), alphabet(t)) for d, v, x, t in zip(b["doc_id"], b["lang"], f, b["text"], strict=True) if x is not None], columns=["doc_id", "lang", "x", "letters"])

    got = picked.mapInPandas(make, "doc_id long, lang string, x binary, letters string").groupBy("doc_id", "lang").agg(F.min("x").alias("x"), F.max("letters").alias("letters")).toPandas().sort_values(["lang", "doc_id"])
    if not len(got):
        return None
    x = np.empty((len(got), DIMS), np.float32)
    for i, raw in enumerate(got["x"]):
        x[i] = np.frombuffer(raw, np.float16)
    return Model(x, list(got["lang"]), list(got["letters"]))


def _told(docs: DataFrame, model: Model | None = None, **how) -> DataFrame:
    """All columns of docs, and __told: a struct of lang_pred and lang_score (see identify)."""
    model = model or train(docs, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known = np.zeros(0x110000, bool)
        known[m.letters if m else []] = True
        for b in batches:
            lang, score = [UNKNOWN] * len(b), np.zeros(len(b))
            for at in range(0, len(b), 512):
                f = [features(t) for t in b.iloc[at : at + 512]] if m else []
                rows = [i for i, x in enumerate(f) if x is not None]
                if rows:
                    names, s = m.predict(np.stack([f[i] for i in rows]))
                    for i, v, p in zip(rows, names, s, strict=True):
                        lang[at + i], score[at + i] = v, p * known_share(b.iloc[at + i], known)
            yield pd.DataFrame({"lang_pred": lang, "lang_score": score})

    # not deterministic, so that Spark doesn't run it once for each use
    return docs.withColumn("__told", tell.asNondeterministic()("text"))


def identify(docs: DataFrame, model: Model | None = None, **how) -> DataFrame:
    """All columns of docs, with lang_pred and lang_score for each whole text.

    ``und`` with score 0 for null texts and texts without a letter, and for all texts if there
    was nothing to learn from. The score is the chance of the family times that of the
    weakest decision among its languages, and the share of letters that the learned texts
    have, so text in another script scores near 0. A model's size depends on the number of languages,
    not on the data, so it may be broadcast. Columns of these names in docs are replaced."""
    told = _told(docs, model, **how)
    return told.select(*[c for c in docs.columns if c not in ("lang_pred", "lang_score")], "__told.lang_pred", "__told.lang_score")


def known_language(docs: DataFrame, least: float = 0.3, **how) -> DataFrame:
    """The documents whose language is told with at least ``least``; ``und`` and the unsure go. All columns stay.

    Two families of two languages give 0.25 to a text that tells nothing; texts of one known
    word score over 0.35, other scripts near 0."""
    told = _told(docs, **how)
    return told.where((F.col("__told.lang_pred") != UNKNOWN) & (F.col("__told.lang_score") >= least)).drop("__told")
