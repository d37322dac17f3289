"""Phrase collocations: counts by HAT-tries in the tasks, merged by prefix, then scored and ranked."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnscape.session import arrow_rows, cut, drop

#: Bits of a word's number in a task, so that three words fill a key of 63 bits.
WORD_BITS = 21
#: Words that a task numbers before it spills all and starts anew; entries of its tries at most; entries at which a container bursts.
WORDS, ENTRIES, BURST = 1 << 19, 1 << 20, 1 << 12
#: Word positions that are counted at once, and characters that are split at once.
POSITIONS, CHARS = 1 << 19, 1 << 20
#: Bits of the filter of frequent phrases. More phrases let more through, which costs rows and changes no result.
FILTER_BITS = 1 << 26
#: Parts that runs are merged in, at least, and words of all texts to a part.
FEWEST_PARTS, PART_WORDS = 128, 1 << 21
#: Between pieces: a byte that UTF-8 never has.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d\x09", bytes(range(97, 123)) + _BREAK * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, size int, phrase string, c long"


# ---- tries -----------------------------------------------------------------------------------


class Trie:
    """Counts of sequences of ``high`` word numbers (0: ended earlier) in hash containers under a shallow trie.

    A container is a hash table from the packed rest of a sequence to its count. One that
    grows over ``burst`` entries bursts into a trie node: a container for each next word. A
    sequence of more than three words starts below a node of its first word."""

    def __init__(self, high: int, burst: int = BURST):
        self.high, self.burst, self.entries = high, burst, 0
        self.root: Counter | dict = {} if high > 3 else Counter()

    def add(self, columns: list[np.ndarray]) -> None:
        top = isinstance(self.root, dict) and not isinstance(self.root, Counter)
        packed = np.zeros(len(columns[0]), np.int64)
        for c in columns[1:] if top else columns:
            packed = packed << WORD_BITS | c
        if top:
            self._deal(self.root, columns[0], packed, self.high - 1)
        else:
            self.root = self._put(self.root, packed.tolist(), self.high)

    def _put(self, at: Counter, keys: list[int], rest: int) -> Counter | dict:
        before = len(at)
        at.update(keys)
        self.entries += len(at) - before
        if len(at) <= self.burst or rest == 1:
            return at
        shift, node = WORD_BITS * (rest - 1), {}
        for key, n in at.items():
            word = key >> shift
            if word not in node:
                node[word] = Counter()
            node[word][key & ((1 << shift) - 1)] = n
        return node

    def _deal(self, node: dict, first: np.ndarray, packed: np.ndarray, rest: int) -> None:
        order = np.argsort(first, kind="stable")
        first, packed = first[order], packed[order]
        starts = np.nonzero(np.diff(first, prepend=-1))[0].tolist()
        keys, shift = packed.tolist(), WORD_BITS * (rest - 1)
        for lo, hi, word in zip(starts, [*starts[1:], len(keys)], first[starts].tolist(), strict=True):
            at = node.get(word)
            if at is None:
                at = Counter()
            if isinstance(at, Counter):
                node[word] = self._put(at, keys[lo:hi], rest)
            else:
                self._deal(at, packed[lo:hi] >> shift, packed[lo:hi] & ((1 << shift) - 1), rest - 1)

    def _flat(self, at: Counter | dict, rest: int, keys: list[int], counts: list[int], base: int = 0) -> int:
        if isinstance(at, Counter):
            keys.extend([base | k for k in at] if base else at)
            counts.extend(at.values())
            return len(at)
        shift = WORD_BITS * (rest - 1)
        return sum(self._flat(below, rest - 1, keys, counts, base | word << shift) for word, below in at.items())

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes out whole subtrees, the largest first, until ``keep`` entries are left: (word, sequence) and counts."""

        def size(at) -> int:
            return len(at) if isinstance(at, Counter) else sum(map(size, at.values()))

        keys: list[int] = []
        counts: list[int] = []
        if isinstance(self.root, Counter):
            self._flat(self.root, self.high, keys, counts)
            self.root, words, first = Counter(), self.high, []
        else:
            names, sizes, left = [], [], self.entries
            large = sorted(((size(at), w) for w, at in self.root.items()), reverse=True) if keep else [(0, w) for w in self.root]
            for _, w in large:
                if left <= keep and keep:
                    break
                sizes.append(self._flat(self.root.pop(w), self.high - 1, keys, counts))
                names.append(w)
                left -= sizes[-1]
            words, first = self.high - 1, [np.repeat(np.array(names, np.int64), sizes)]
        self.entries -= len(keys)
        packed, mask = np.array(keys, np.int64), (1 << WORD_BITS) - 1
        return np.stack([*first, *(packed >> WORD_BITS * (words - 1 - i) & mask for i in range(words))]), np.array(counts, np.int64)


class Gate:
    """The fixed-size filter of frequent phrases of ``size`` words; it may let others through."""

    def __init__(self, size: int, bits: np.ndarray | None):
        self.size, self.bits = size, bits

    def open(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in places(h, 8 * len(self.bits)):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each hash of 48 bits among ``bits``, a power of two."""
    return [(x & np.uint64(bits - 1)).astype(np.int64) for x in (h, h * _MIX >> np.uint64(20))]


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from the hashes of their words, one array for each place."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Numbers(dict):
    """Numbers words as they come, from 1; breaks are 0."""

    def __init__(self, lang: str):
        super().__init__({_BREAK: 0})
        self.seed, self.names, self.hashes = xxhash.xxh32_intdigest(lang.encode()), [b""], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.names.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return n


class Stream:
    """The words of one language in a task, numbered as they come, and the trie of their phrases."""

    def __init__(self, lang: str, high: int, burst: int):
        self.lang, self.trie, self.size, self.held = lang, Trie(high, burst), 0, []
        self.numbers = Numbers(lang)
        self.singles = np.zeros(0, np.int64)

    def take(self, tokens: list[bytes]) -> int:
        """How many of the tokens are words."""
        ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
        self.held.append(ids)
        self.size += len(ids)
        return int(np.count_nonzero(ids))

    def positions(self, high: int, last: bool) -> tuple[np.ndarray, int]:
        """The held word numbers, ``high`` zeros after them, and at how many places a phrase may start; the few whose phrase may go on in what comes next are held on to."""
        ids = np.concatenate(self.held).astype(np.int64) if self.held else np.empty(0, np.int64)
        n = len(ids) if last else max(0, len(ids) - high + 1)
        self.held, self.size = ([], 0) if last else ([ids[n:]], len(ids) - n)
        return np.concatenate([ids, np.zeros(high, np.int64)]), n

    def fitting(self, at: np.ndarray, n: int, high: int, gates: list[Gate]) -> list[np.ndarray]:
        """For word i of the phrases at n places: whether there is one, and each gate is open for the words that end with it."""
        word, hashes = at[: n + high] > 0, np.array(self.numbers.hashes, np.uint64)
        fits = [word[i : i + n].copy() for i in range(high)]
        for gate in gates:
            span = n + high - gate.size
            there = np.logical_and.reduce([word[i : i + span] for i in range(gate.size)])
            some = np.nonzero(there)[0]
            there[some] = gate.open(phrase_hash([hashes[at[some + i]] for i in range(gate.size)]) >> np.uint64(16))
            for i in range(gate.size - 1, high):
                fits[i] &= there[i - gate.size + 1 : i - gate.size + 1 + n]
        return fits

    def count(self, gates: list[Gate], last: bool) -> None:
        """Counts the words at all held places, and puts the phrases of two words and more into the trie."""
        at, n = self.positions(self.trie.high, last)
        columns, on = [], np.ones(n, bool)
        for i, fits in enumerate(self.fitting(at, n, self.trie.high, gates)):
            on = on & fits
            columns.append(np.where(on, at[i : i + n], 0))
        singles = np.bincount(columns[0], minlength=len(self.numbers.names))
        singles[: len(self.singles)] += self.singles
        self.singles = singles
        if len(columns) > 1:
            rows = np.nonzero(columns[1])[0]
            if len(rows):
                self.trie.add([c[rows] for c in columns])

    def hashed(self, size: int, gates: list[Gate], last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the phrases of ``size`` words at all held places, and how often each occurs."""
        at, n = self.positions(size, last)
        rows = np.nonzero(np.logical_and.reduce(self.fitting(at, n, size, gates)))[0]
        hashes = np.array(self.numbers.hashes, np.uint64)
        h, c = np.unique(phrase_hash([hashes[at[rows + i]] for i in range(size)]) >> np.uint64(16), return_counts=True)
        return h, c.astype(np.int64)

    def runs(self, keep: int, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Spilled subtrees as sorted runs, one for each prefix partition: (part, phrases, counts), packed.

        A phrase counts as often as all sequences that begin with it. The partition goes by
        all words but the last. With nothing to keep, the words themselves come too."""
        columns, counts = self.trie.spill(keep)
        names, hashes = self.numbers.names, np.array(self.numbers.hashes, np.uint64)
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        order = np.lexsort([rank[c] for c in columns[::-1]])
        columns, counts = columns[:, order], counts[order]
        words = pa.array(names, pa.binary()).cast(pa.string())
        found = []
        if not keep:
            once = np.nonzero(self.singles)[0]
            once = once[once > 0]
            once = once[np.argsort(rank[once])]
            found.append((phrase_hash([hashes[once]]), words.take(pa.array(once)), self.singles[once]))
            self.singles = np.zeros(0, np.int64)
        new = np.zeros(len(counts), bool)
        for size in range(1, len(columns) + 1):
            new |= np.diff(columns[size - 1], prepend=-1) != 0
            starts = np.nonzero(new)[0]
            if size == 1 or not len(starts):
                continue
            sums = np.add.reduceat(counts, starts)
            there = columns[size - 1][starts] > 0
            starts, sums = starts[there], sums[there]
            phrase = pc.binary_join_element_wise(*[words.take(pa.array(c[starts])) for c in columns[:size]], " ")
            found.append((phrase_hash([hashes[c[starts]] for c in columns[: size - 1]]), phrase, sums))
        if found:
            part = np.concatenate([f[0] for f in found]) % np.uint64(parts)
            phrases, sums = pa.concat_arrays([f[1] for f in found]), np.concatenate([f[2] for f in found])
            order = np.argsort(part, kind="stable")
            at = np.append(np.nonzero(np.diff(part[order].astype(np.int64), prepend=-1))[0], len(order)).tolist()
            phrases, sums = phrases.take(pa.array(order)).to_pylist(), sums[order]
            for lo, hi in zip(at, at[1:], strict=False):
                yield int(part[order[lo]]), zlib.compress("\n".join(phrases[lo:hi]).encode(), 1), zlib.compress(sums[lo:hi].tobytes(), 1)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lower case (A-Z), with a break between pieces; long texts come in parts that end at a blank."""
    flat = text.translate(_TABLE)
    at = 0
    while at < len(flat):
        end = len(flat)
        if end - at > CHARS:
            cuts = [i for i in (flat.find(b" ", at + CHARS), flat.find(_BREAK, at + CHARS)) if i >= 0]
            end = min(cuts, default=end)
        yield flat[at:end].replace(_BREAK, b" \xff ").split()
        at = end
    yield [_BREAK]


def _pack(h: np.ndarray) -> bytes:
    """Sorted 48-bit numbers: the steps between them, byte by byte, so that the upper bytes are zeros."""
    return zlib.compress(np.ascontiguousarray(np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T[:6]).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    low = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(6, -1)
    steps = np.zeros((low.shape[1], 8), np.uint8)
    steps[:, :6] = low.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    h, c = h[order], np.concatenate(counts)[order]
    starts = np.nonzero(np.append(True, h[1:] != h[:-1]))[0] if len(h) else np.empty(0, np.int64)
    return h[starts], np.add.reduceat(c, starts) if len(starts) else c


def hash_runs(docs: DataFrame, size: int, gates: list[Gate], parts: int, words: int = WORDS, entries: int = ENTRIES) -> DataFrame:
    """(part, n, h, c): packed sorted runs of the hashes (48 bits) of all phrases of ``size`` words that pass the gates, with their counts.

    A part has a range of hashes. One row has part -1: n is the number of all words of the task."""
    shared = docs.sparkSession.sparkContext.broadcast(gates)

    def count(batches):
        gates, streams, known, held, size_held, total = shared.value, {}, 0, [], 0, 0

        def emptied():
            h, c = _summed([x[0] for x in held], [x[1] for x in held])
            part = (h * np.uint64(parts) >> np.uint64(48)).astype(np.int64) if parts < 1 << 16 else (h.astype(np.float64) * parts / 2.0**48).astype(np.int64)
            at = np.append(np.nonzero(np.diff(part, prepend=-1))[0], len(h)).tolist()
            rows = list(zip(at, at[1:], strict=False))
            if rows:
                columns = [pa.array([int(part[lo]) for lo, _ in rows], pa.int64()), pa.array([hi - lo for lo, hi in rows], pa.int64()), pa.array([_pack(h[lo:hi]) for lo, hi in rows], pa.binary()), pa.array([zlib.compress(c[lo:hi].tobytes(), 1) for lo, hi in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "n", "h", "c"])

        for lang, some in chain(_parts(batches), [(None, None)]):
            end = some is None
            if not end:
                s = streams.get(lang) or streams.setdefault(lang, Stream(lang, 1, BURST))
                before = len(s.numbers)
                total += s.take(some)
                known += len(s.numbers) - before
            crowded = known + 64 * len(streams) > words
            # all texts but the one at hand end with a break
            for k in streams if end or crowded else [lang] if s.size >= POSITIONS else []:
                h, c = streams[k].hashed(size, gates, k != lang)
                held.append((h, c))
                size_held += len(h)
            if crowded and not end:
                open_words = [s.numbers.names[i] or _BREAK for ids in s.held for i in ids.tolist()]
                streams = {lang: Stream(lang, 1, BURST)}
                streams[lang].take(open_words)
                known = len(streams[lang].numbers)
            if held and (end or size_held > 2 * entries):
                yield from emptied()
                held, size_held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total], pa.int64()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], names=["part", "n", "h", "c"])

    return _texts(docs).mapInArrow(count, "part long, n long, h binary, c binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def _parts(batches) -> Iterator[tuple[str, list[bytes]]]:
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
            raw = text.as_py()
            for some in tokens(raw) if raw else ():
                yield lang, some


def trie_runs(docs: DataFrame, high: int, gates: list[Gate], parts: int, words: int = WORDS, entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """(lang, part, n, phrases, counts): packed sorted runs of the counts of phrases of one to ``high`` words (see Stream.runs); part -1 has n words of the language.

    Every gate is open for each of its sizes of words in a row of a phrase."""
    shared = docs.sparkSession.sparkContext.broadcast(gates)

    def count(batches):
        gates, streams, totals = shared.value, {}, Counter()
        used = {"words": 0, "entries": 0}

        def counted(s: Stream, last: bool) -> None:
            before = s.trie.entries
            s.count(gates, last)
            used["entries"] += s.trie.entries - before

        def spilled(s: Stream, keep: int):
            before = s.trie.entries
            rows = list(s.runs(keep, parts))
            used["entries"] += s.trie.entries - before
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([s.lang] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["lang", "part", "n", "phrases", "counts"])

        def renewed(now: str | None):
            """All is spilled; the open end of the text at hand goes on under new numbers."""
            for lang in list(streams):
                s = streams.pop(lang)
                counted(s, lang != now)
                yield from spilled(s, 0)
                if lang == now:
                    streams[lang] = Stream(lang, high, burst)
                    streams[lang].take([s.numbers.names[i] or _BREAK for ids in s.held for i in ids.tolist()])
            used["words"] = sum(len(s.numbers) for s in streams.values())

        for lang, some in _parts(batches):
            s = streams.get(lang) or streams.setdefault(lang, Stream(lang, high, burst))
            before = len(s.numbers)
            totals[lang] += s.take(some)
            used["words"] += len(s.numbers) - before
            if s.size >= POSITIONS:
                counted(s, False)
            if used["words"] + 64 * len(streams) > words:
                yield from renewed(lang)
            elif used["entries"] > entries:
                for s in streams.values():  # half of the entries are left at most
                    yield from spilled(s, max(1, entries // (2 * len(streams))))
        yield from renewed(None)
        rows = [(k, n) for k, n in totals.items() if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([-1] * len(rows), pa.int64()), pa.array([n for _, n in rows], pa.int64()), pa.array([b""] * len(rows), pa.binary()), pa.array([b""] * len(rows), pa.binary())], names=["lang", "part", "n", "phrases", "counts"])

    return _texts(docs).mapInArrow(count, "lang string, part long, n long, phrases binary, counts binary")


def _grouped(batches, keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with equal keys, of sorted batches."""
    rows = (r for b in batches for r in b.to_pylist())
    yield from ((k, list(g)) for k, g in groupby(rows, key=lambda r: tuple(r[c] for c in keys)))


def merged(runs: DataFrame, least: int) -> DataFrame:
    """(lang, size, phrase, c): sorted runs merged by prefix partition, without phrases under ``least``; size 0 has the words of a language."""

    def merge(batches):
        for (lang, _), rows in _grouped(batches, ["lang", "part"]):
            phrases = pa.array([p for r in rows for p in zlib.decompress(r["phrases"]).decode().split("\n")])
            counts = pa.array(np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in rows]))
            sums = pa.table({"phrase": phrases, "c": counts}).group_by("phrase").aggregate([("c", "sum")])
            sums = sums.filter(pc.greater_equal(sums["c_sum"], least))
            if len(sums):
                phrase = sums["phrase"].combine_chunks()
                size = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums)), size, phrase, sums["c_sum"].combine_chunks()], names=["lang", "size", "phrase", "c"])

    held = cut(runs, "runs")
    some = held.where("part >= 0").repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(merge, COUNTS)
    total = held.where("part < 0").groupBy("lang").agg(F.sum("n").alias("c"))
    return some.unionByName(total.select("lang", F.lit(0).alias("size"), F.lit("").alias("phrase"), "c"))


def gate_of(runs: DataFrame, size: int, least: int, bits: int = FILTER_BITS) -> tuple[Gate, int]:
    """The filter of all phrases of ``size`` words whose hash counts ``least`` or more, and the number of all words.

    A part of the hashes is merged at a time; tasks set bits, aggregates join their bitmaps,
    and the driver gets one of ``bits`` bits."""

    def often(batches):
        for _, rows in _grouped(batches, ["part"]):
            h, c = _summed([_unpack(r["h"]) for r in rows], [np.frombuffer(zlib.decompress(r["c"]), np.int64) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places(h[c >= least], bits)))], names=["at"])

    held = cut(runs, "hashes")
    total = held.where("part < 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    at = held.where("part >= 0").repartition("part").sortWithinPartitions("part").mapInArrow(often, "at long")
    maps = at.groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    with arrow_rows(runs.sparkSession, 256):  # rows are runs
        pages = maps.collect()
    for r in pages:
        got = np.frombuffer(bytes(r["bits"]), np.uint8)
        begin = r["page"] * 4096
        out[begin : begin + len(got)] = got[: len(out) - begin]
    drop(held)
    return Gate(size, out), total


def phrase_counts(docs: DataFrame, most: int = 4, least: int = 30, bits: int = FILTER_BITS, words: int = WORDS, entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """(lang, size, phrase, c): all phrases of one to ``most`` words that occur ``least`` times or more; size 0 has the words of a language.

    Every part of a frequent phrase is frequent too. So passes over the texts first count
    hashes: of words, of pairs of frequent words, of threes whose pairs are frequent; what is
    frequent goes into filters of fixed size, which never leave out a frequent phrase. The
    last pass counts the phrases that pass them in tries. Counts are exact. Runs are packed, a
    row for each task, spill and part; there are as many parts as keep each to some million
    words. ``lang`` null counts as "und"."""
    gates: list[Gate] = []
    parts = FEWEST_PARTS
    for size in range(1, most):
        gate, total = gate_of(hash_runs(docs, size, gates[-1:], parts, words, entries), size, least, bits)
        gates.append(gate)
        parts = max(FEWEST_PARTS, total // PART_WORDS)
    return merged(trie_runs(docs, most, gates, parts, words, entries, burst), least)


# ---- scores ----------------------------------------------------------------------------------


def _words(at: Column | str, first: Column | int, many: Column | int) -> Column:
    return F.array_join(F.slice(at, first, many), " ")


def collocations(docs: DataFrame, most: int = 4, least: int = 30, top: int = 2000, inside: int = 80, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``most`` words by score.

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into pieces, and these
    at blanks and tabs into words. a is how often a phrase occurs within pieces, overlaps
    included; l and r are the same of the parts before and after a cut; the score is
    floor(2,000,000 a / (l + r)) at the cut where it is lowest (ties: the first cut). Phrases
    under ``least`` occurrences aren't candidates, nor those that stand in a longer candidate
    that has at least ``inside`` % of their occurrences. n is the number of words of the
    language. Order: score and a descending, then the phrase's bytes.

    Tasks count in tries of bounded size (see Trie) and spill sorted runs, which are merged by
    prefix (see phrase_counts). Ranking keeps ``top`` rows of each language and task before
    they meet. Products are decimals, as they may pass 64 bits.

    Null and empty texts have no phrases; null languages are "und", together with documents
    of that name. Repeated documents count each. Other columns aren't read; an empty table
    gives no rows."""
    found = phrase_counts(docs, most, least, **how)
    with arrow_rows(docs.sparkSession, 256):  # rows are runs
        counts = cut(found, "counts")
    w = counts.where("size > 0").select("lang", "phrase", "size", F.col("c").alias("a"), F.split("phrase", " ").alias("w"))
    several = w.where("size > 1")
    cuts = several.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words("w", F.lit(1), F.col("k")).alias("left"), _words("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = w.select("lang", F.col("phrase").alias("p"), F.col("a").alias("c"))
    cuts = cuts.join(part.select("lang", F.col("p").alias("left"), F.col("c").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("p").alias("right"), F.col("c").alias("r")), ["lang", "right"])
    exact = F.expr("CAST(a AS DECIMAL(20,0)) * 2000000 div (CAST(l AS DECIMAL(20,0)) + r)")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # words i to i + size - 1 of a longer candidate
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.array_join(F.slice("w", i, s), " "))))
    longer = w.where("size > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.expr(f"over IS NULL OR CAST(over AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {inside}"))
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    # bounded: `top` rows a language
    n = counts.where("size = 0").select("lang", F.col("c").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").cast("long").alias("score"))
