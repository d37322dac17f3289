"""Phrase collocations against plain counting."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tarnscape.llm import collocations, queries
from test_llm import DOC, HARD
from verify_oracle import canon

SF = "/root/testdata/sf0.001"


def brute_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least=30, top=2000):
    f, n = brute_counts(rows)
    f = {k: c for k, c in f.items() if c >= least}
    inside = {}
    for (lang, w), c in f.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(c, inside.get((lang, w[i:j]), 0))
    out = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * inside.get((lang, w), 0) < 80 * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, each in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(each)[:top], 1))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["é", "日本", "x\xa0y", "a\x01", "--", "ß"]
    rows = []
    for i in range(docs):
        words = [rng.choice(vocabulary[: rng.choice([4, 12, 31])]) for _ in range(rng.choice([0, 3, 40, 200]))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", ", "!"]) for w in words)
        rows.append((rng.choice(["en", "EN", None, "und", "de"]), text.upper() if i % 4 == 0 else text))
    return rows + [("en", t) for t in HARD] + [("fr", "the same line of words. " * 70), ("fr", None), ("lone", "a b a b a b " * 30)]


def frame(spark, rows):
    return spark.createDataFrame([(i % 9 or None, t, g, None, None) for i, (g, t) in enumerate(rows)], DOC).selectExpr("*", "1 AS phrase", "2 AS a", "3 AS n", "4 AS c", "5 AS size", "6 AS rank")


@pytest.mark.parametrize("least", [2, 30])
def test_equals_brute_force(spark, least):
    rows = made(least)
    df = frame(spark, rows).repartition(5)
    assert got(collocations.collocations(df, least=least)) == brute(rows, least)
    assert got(collocations.collocations(df, least=least, top=3)) == brute(rows, least, 3)


def test_small_memory_spills_and_bursts_to_the_same_counts(spark, monkeypatch):
    """Tries that burst at 3 entries, spill at 40, and number 60 words at most; texts in parts of 50 characters."""
    monkeypatch.setattr(collocations, "CHARS", 50)
    monkeypatch.setattr(collocations, "POSITIONS", 30)
    rows = made(7)
    f, n = brute_counts(rows)
    want = sorted([(g, len(w), " ".join(w), c) for (g, w), c in f.items() if c >= 4] + [(g, 0, "", c) for g, c in n.items() if c])
    for bits in (1 << 20, 1 << 15):  # a filter that lets most phrases through changes nothing
        some = collocations.phrase_counts(frame(spark, rows).repartition(2), least=4, bits=bits, words=300, entries=40, burst=3)
        assert got(some) == want


def test_parts_of_a_text_count_as_one(monkeypatch):
    rows = made(3)
    monkeypatch.setattr(collocations, "CHARS", 7)
    trie = {}
    for g, t in rows:
        s = trie.setdefault(g, collocations.Stream(str(g), 4, 2))
        for some in collocations.tokens(t.encode()) if t else ():
            s.take(some)
            if s.size > 5:
                s.count([], False)
    f, _ = brute_counts([(str(g), t) for g, t in rows])
    found = Counter()
    for s in trie.values():
        s.count([], True)
        for _, phrases, counts in s.runs(0, 7):
            for p, c in zip(zlib.decompress(phrases).decode().split("\n"), np.frombuffer(zlib.decompress(counts), np.int64), strict=True):
                found[s.lang, tuple(p.split(" "))] += int(c)
        assert s.trie.entries == 0
    assert found == f


@pytest.mark.parametrize("high", [2, 3, 4])
def test_largest_subtrees_leave_first_and_nothing_is_lost(high):
    t = collocations.Trie(high, 4)
    rng = np.random.default_rng(0)
    columns = [rng.integers(1, 5 + 20 * i, 800) for i in range(high)]
    t.add([c[:500] for c in columns])
    t.add([c[500:] for c in columns])
    before = t.entries
    part, n = t.spill(before // 2)
    assert len(n) and not set(t.root) & set(part[0].tolist()) and t.entries <= before // 2 < before
    rest, m = t.spill(0)
    got = Counter()
    for c, k in ((part, n), (rest, m)):
        for row, count in zip(c.T.tolist(), k.tolist(), strict=True):
            got[tuple(row)] += count
    assert got == Counter(zip(*(c.tolist() for c in columns), strict=True)) and t.entries == 0


def test_runs_of_hashes_come_back():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 2**48, 5000).astype(np.uint64))
    assert (collocations._unpack(collocations._pack(h)) == h).all()
    a, b = collocations._summed([h, h[::2]], [np.ones(len(h), np.int64), np.full(len(h[::2]), 3)])
    assert (a == h).all() and (b[::2] == 4).all() and (b[1::2] == 1).all()


def test_empty_tables(spark):
    none = frame(spark, made(1)).limit(0)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(frame(spark, [("en", None), (None, ""), ("de", "one two")])).count() == 0


def test_query_and_sql(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    q = queries.op12_collocations(spark, SF)
    assert dict(q.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")
    assert got(q) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(queries.ORACLE["op12_collocations"])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert canon(q.toPandas()) == canon(want)
