"""Benchmark decontamination: CGK embedding and bit-sampling LSH over windows, then exact edit distance."""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnscape.session import cut

#: Random walks, and sample sets (tables) of each.
WALKS, TABLES = 4, 4
#: Window sizes: for items of so many characters at least, steps of the walk and symbols in a sample.
CLASSES = ((80, 40, 12), (40, 32, 10), (16, 24, 8), (6, 8, 5), (1, 2, 2))
#: Characters of a piece that is compared before the whole item, and the share of edits at which it is dropped.
PIECE, PIECE_RATE = 64, 0.4
#: Items below this size are looked for at every character of a text, longer ones at the beginnings of words.
EVERYWHERE = 16
#: Pairs of windows that are held at a time, and compared at a time.
PAIRS = 1 << 20
_LANES = 1 << 14
_SLOT_BITS = 20


def normal(text: str | None) -> str:
    """Lower case with single blanks. Very long texts go without a list of their words."""
    low = (text or "").lower()
    return re.sub(r"\s+", " ", low).strip() if len(low) > 1 << 22 else " ".join(low.split())


def coded(text: str) -> np.ndarray:
    """A symbol of 8 bits for each character."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def beginnings(text: str) -> np.ndarray:
    """Where windows start: after anything but a letter or digit, and at each character of scripts without blanks."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = (x > 127) | ((x >= 48) & (x <= 57)) | ((x >= 97) & (x <= 122))
    first = np.ones(len(x), bool)
    first[1:] = ~word[:-1] | (x[1:] >= 0x0E00)
    return np.nonzero(first & word)[0] if (first & word).any() else np.zeros(min(1, len(x)), np.int64)


class Walks:
    """Random walks of the CGK embedding, and the steps that each table samples.

    At each step a walk writes the symbol under it and then stays or moves on by one, as a
    random bit of (walk, step, symbol) says. Two texts that differ by few edits fall into
    step again soon, so they agree in most places of the embedding."""

    def __init__(self, seed: int = 77):
        rng = np.random.default_rng(seed)
        longest = max(c[1] for c in CLASSES)
        self.move = rng.integers(0, 2, (WALKS, longest, 256)).astype(np.int64)
        self.value = rng.integers(0, 2**63, (WALKS, longest, 256), dtype=np.int64).astype(np.uint64)
        self.steps = [[[np.sort(rng.choice(steps, size, replace=False)) for _ in range(TABLES)] for _, steps, size in CLASSES] for _ in range(WALKS)]

    def keys(self, code: np.ndarray, at: np.ndarray, classes: list[int]):
        """Gives (walk, class, table, key of each window that starts at ``at``); windows may run past the end."""
        longest = max((CLASSES[c][1] for c in classes), default=0)
        for w in range(WALKS):
            here = at.copy()
            sums = {(c, t): np.zeros(len(at), np.uint64) for c in classes for t in range(TABLES)}
            takes = [[k for k in sums if j in self.steps[w][k[0]][k[1]]] for j in range(longest)]
            for j in range(longest):
                symbol = code.take(here, mode="clip")
                if takes[j]:
                    value = self.value[w, j].take(symbol)
                    for k in takes[j]:
                        # order counts, as a sample's places are told apart by their values
                        sums[k] += value
                here += self.move[w, j].take(symbol)
            for (c, t), k in sums.items():
                yield w, c, t, k


class Bench:
    """Items of a block of the benchmark, with a table of their windows for each walk and sample."""

    def __init__(self, ids: list[int], texts: list[str], rate: float = 0.2):
        flat = [normal(t) for t in texts]
        keep = [i for i, t in enumerate(flat) if t]
        self.ids = [ids[i] for i in keep]
        self.texts = [flat[i] for i in keep]
        self.slack = [int(rate * len(t)) for t in self.texts]
        self.walks = Walks()
        self.longest = max(map(len, self.texts), default=0)
        self.classes: list[int] = []
        item, start, size, kind = [], [], [], []
        code = [coded(t) for t in self.texts]
        off = np.concatenate([[0], np.cumsum([len(x) + 64 for x in code])]).astype(np.int64)
        for n, t in enumerate(self.texts):
            c = next(k for k, (least, _, _) in enumerate(CLASSES) if len(t) >= least)
            at = beginnings(t)
            # a walk moves on at half of its steps, so it stays in the item nearly always
            at = at[len(t) - at >= min(len(t) - at[0], int(0.6 * CLASSES[c][1]))]
            item.append(np.full(len(at), n))
            start.append(at)
            kind.append(np.full(len(at), c))
        cat = lambda v: np.concatenate([*v, np.empty(0, np.int64)]).astype(np.int64)
        self.item, self.start, kind = cat(item), cat(start), cat(kind)
        all_code = np.concatenate([np.concatenate([x, np.zeros(64, np.uint8)]) for x in code] or [np.zeros(64, np.uint8)])
        self.classes = sorted(set(kind.tolist()))
        #: for (walk, class, table): keys in order, and the window of each
        self.tables = {}
        for c in self.classes:
            who = np.nonzero(kind == c)[0]
            for w, _, t, k in self.walks.keys(all_code, off[self.item[who]] + self.start[who], [c]):
                order = np.lexsort((who, self.item[who], k))
                k, own = k[order], who[order]
                # of equal windows of an item, the first and the last do: the places between lie between
                same = (k[1:] == k[:-1]) & (self.item[own[1:]] == self.item[own[:-1]])
                keep = ~(np.append(same, False) & np.append(False, same))
                self.tables[w, c, t] = (k[keep], own[keep])
        self._pieces()

    def _pieces(self) -> None:
        """The pieces of all items as bit masks for each symbol, and the piece of each window."""
        first, self.lo, self.size, masks = [0], [], [], []
        for t in self.texts:
            h = -(-len(t) // PIECE)
            ends = [len(t) * k // h for k in range(h + 1)]
            x = coded(t)
            for a, b in zip(ends, ends[1:], strict=False):
                m = np.zeros(256, np.uint64)
                for k, c in enumerate(x[a:b]):
                    m[c] |= np.uint64(1 << k)
                masks.append(m)
                self.lo.append(a)
                self.size.append(b - a)
            first.append(first[-1] + h)
        self.lo, self.size = np.array(self.lo, np.int64), np.array(self.size, np.int64)
        self.masks = np.concatenate([*masks, np.empty(0, np.uint64)])
        self.first = np.array(first, np.int64)
        whole = np.diff(self.first) == 1
        slack = np.array(self.slack, np.int64)
        owner = np.repeat(np.arange(len(self.texts)), np.diff(self.first))
        self.most = np.where(whole[owner], slack[owner], (PIECE_RATE * self.size).astype(np.int64)) if len(owner) else slack
        self.piece = np.array([np.searchsorted(self.lo[self.first[i] : self.first[i + 1]], a, "right") - 1 + self.first[i] for i, a in zip(self.item, self.start, strict=True)], np.int64)


def _slot(k: np.ndarray) -> np.ndarray:
    return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def windows_found(code: np.ndarray, at: np.ndarray, bench: Bench, classes: list[int], slots: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in the text, window of the benchmark) of all windows that share a key, in batches of about PAIRS pairs at most, once each in a batch.

    So a phrase that many items and texts share costs time, not memory."""
    held, size = [], 0
    for lo in range(0, len(at), 1 << 15):
        part = at[lo : lo + (1 << 15)]
        for w, c, t, k in bench.walks.keys(code, part, classes):
            known, who = bench.tables[w, c, t]
            if (w, c, t) not in slots:
                slots[w, c, t] = np.zeros(1 << _SLOT_BITS, bool)
                slots[w, c, t][_slot(known)] = True
            maybe = np.nonzero(slots[w, c, t].take(_slot(k)))[0]
            first = np.searchsorted(known, k[maybe], "left")
            many = np.searchsorted(known, k[maybe], "right") - first
            if not many.any():
                continue
            cut_at = np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), PAIRS), "right")
            for a, b in zip(cut_at, [*cut_at[1:], len(many)], strict=True):
                m = many[a:b]
                run = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                held.append(np.repeat(part[maybe[a:b]], m) * len(bench.item) + who[np.repeat(first[a:b], m) + run])
                size += len(run)
                if size >= PAIRS:
                    both = np.unique(np.concatenate(held))
                    held, size = [], 0
                    yield both // len(bench.item), both % len(bench.item)
    if held:
        both = np.unique(np.concatenate(held))
        yield both // len(bench.item), both % len(bench.item)


def like(code: np.ndarray, place: np.ndarray, window: np.ndarray, bench: Bench) -> np.ndarray:
    """Whether the piece around each window is near enough to the text there.

    The bit vectors of infix_distance, in one word for each pair; all pairs go on together.
    A short item is one piece and its bound is the item's own. Of a longer item, the piece
    that led here may have up to PIECE_RATE of its characters edited."""
    piece = bench.piece[window]
    size, most = bench.size[piece], bench.most[piece]
    drift = np.maximum(most, 2)
    begin = place - (bench.start[window] - bench.lo[piece]) - drift
    steps = int((size + 2 * drift).max(initial=0))
    ones = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
    ones[size == 64] = np.uint64(2**64 - 1)
    top = np.uint64(1) << (size - 1).astype(np.uint64)
    base = piece * 256
    up, down = ones.copy(), np.zeros(len(piece), np.uint64)
    score, best = size.astype(np.int16), size.astype(np.int16)
    one = np.uint64(1)
    last = len(code) - 1
    for j in range(steps):
        eq = bench.masks.take(code.take(np.clip(begin + j, 0, last)) + base)
        d = (((eq & up) + up) ^ up) | eq | down
        h = down | ~(d | up)
        low = up & d
        score += ((h & top) != 0).astype(np.int16) - ((low & top) != 0)
        h <<= one
        low <<= one
        up = low | ~(d | h)
        down = h & d
        np.minimum(best, score, out=best)
    return best <= most


def infix_distance(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of item to a substring of text, and where the first such one ends.

    Bit vectors of a column of the dynamic program, one addition a character."""
    n = len(item)
    ones = (1 << n) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, top = ones, 0, n, 1 << (n - 1)
    best, end = n, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        d = (((eq & up) + up) ^ up) | eq | down
        h = down | (ones & ~(d | up))
        low = up & d
        if h & top:
            score += 1
        elif low & top:
            score -= 1
        h <<= 1
        low <<= 1
        up = (low | (ones & ~(d | h))) & ones
        down = h & d & ones
        if score < best:
            best, end = score, j + 1
    return best, end


def hits_of(texts: list, bench: Bench, at_once: int = 1 << 20) -> list[tuple[int, int, int, int]]:
    """(text index, item index, edits, end of the match) of whole texts, the best for each pair."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    slots: dict = {}
    tiny = [c for c in bench.classes if CLASSES[c][0] < EVERYWHERE]
    rest = [c for c in bench.classes if c not in tiny]
    slack, sizes = np.array(bench.slack, np.int64), np.array([len(t) for t in bench.texts], np.int64)

    def search(group: list[tuple[int, str]]) -> None:
        gap = "\0" * 64
        code = coded(gap.join([*(t for _, t in group), ""]))
        offset = np.cumsum([0, *(len(t) + 64 for _, t in group)])
        place, window = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for classes, starts in ((rest, [beginnings(t) for _, t in group]), (tiny, [np.arange(len(t)) for _, t in group] if tiny else [])):
            if classes:
                for p, w in windows_found(code, np.concatenate([s + offset[k] for k, s in enumerate(starts)]), bench, classes, slots):
                    ok = np.concatenate([like(code, p[a : a + _LANES], w[a : a + _LANES], bench) for a in range(0, len(p), _LANES)] or [np.empty(0, bool)])
                    place.append(p[ok])
                    window.append(w[ok])
        place, window = np.concatenate(place), np.concatenate(window)
        item = bench.item[window]
        text = np.searchsorted(offset, place, "right") - 1
        low = place - offset[text] - bench.start[window] - 2 * slack[item]
        high = low + sizes[item] + 4 * slack[item]
        order = np.lexsort((low, item, text))
        a = 0
        while a < len(order):
            n, i, end, z = text[order[a]], item[order[a]], high[order[a]], a + 1
            while z < len(order) and text[order[z]] == n and item[order[z]] == i and low[order[z]] <= end:
                end, z = max(end, high[order[z]]), z + 1
            begin = max(0, int(low[order[a]]))
            d, stop = infix_distance(bench.texts[i], group[n][1][begin : max(0, int(end))])
            if d <= slack[i]:
                key = (group[n][0], int(i))
                best[key] = min(best.get(key, (d, begin + stop)), (d, begin + stop))
            a = z

    group: list[tuple[int, str]] = []
    held = 0
    for n, text in enumerate(texts):
        flat = normal(text)
        if flat and bench.classes:
            group.append((n, flat))
            held += len(flat)
        if held >= at_once:
            search(group)
            group, held = [], 0
    if group:
        search(group)
    return [(n, i, d, end) for (n, i), (d, end) in sorted(best.items())]


def blocks_of(items: DataFrame, block_chars: int, most: int = 1 << 16) -> int:
    """In how many blocks, dealt by hash, no block has more than ``block_chars`` characters.

    Doubled until that holds, or until the largest block is a single item, which can't be split."""
    blocks = 1
    while blocks < most:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        top = items.groupBy(part.alias("b")).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).agg(F.max("size")).first()[0]
        if (top or 0) <= block_chars:
            break
        blocks *= 2
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, block_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, edits, item_chars, at_end): items that documents contain, with few edits.

    Texts and items are compared in lower case with single blanks. A document contains an
    item if a substring is within ``rate`` edits per character of the item. Windows of texts
    and items, of a size that goes by the item's (CLASSES), are embedded by WALKS random walks,
    and TABLES samples of each embedding are their keys. Every window of an item is in the
    tables, so an item has as many chances as it has words. Windows with equal keys are
    compared piece by piece, and around those that are like, the exact edit distance decides.
    So every row is right, and some may be missing: of random edits at the full rate, recall
    is measured as 0.95 or more for items of 60 characters and 0.9 for shorter ones.

    The benchmark goes to the tasks in blocks of at most ``block_chars`` characters, checked
    before each broadcast, one pass over the documents for each; an item longer than a block
    is a block of its own. Null or blank items and texts match nothing; equal items each
    count, as do repeated rows of documents, once for each doc_id and item. Other columns of
    both tables aren't read, so their names can't clash."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text", F.length("text").alias("n")).distinct()
    blocks = blocks_of(items, block_chars)
    out = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").collect()
        mine.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        shared = spark.sparkContext.broadcast(Bench([r["item_id"] for r in mine], [r["text"] for r in mine], rate))

        def find(batches, shared=shared):
            bench = shared.value
            for batch in batches:
                docs_of = batch["doc_id"].tolist()
                rows = [(docs_of[n], bench.ids[i], d, len(bench.texts[i]), end) for n, i, d, end in hits_of(batch["text"].tolist(), bench)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "item_chars", "at_end"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        got = docs.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(find, "doc_id long, item_id long, edits long, item_chars long, at_end long")
        out = got if out is None else out.union(got)
    best = F.min(F.struct("edits", "at_end", "item_chars")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.edits", "b.item_chars", "b.at_end")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents whose text contains no benchmark item, with their columns.

    Texts are known by a hash of their own, so a document goes only for its own text,
    whatever doc_id it has or shares; null texts stay."""
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("doc_id"), "text")
    bad = cut(contamination(texts, benchmark, **how).select(F.col("doc_id").alias("__bad")).distinct(), "leaks")
    rows = docs.select(F.xxhash64("text").alias("h"), F.col("text").isNotNull().alias("told"), F.struct(*docs.columns).alias("row"))
    return rows.join(bad, F.expr("told AND h = __bad"), "left_anti").select("row.*")
