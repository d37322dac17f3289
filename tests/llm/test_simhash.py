"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tarnscape.llm import queries, simhash
from test_llm import DOC, HARD, docs_of

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, radius=2):
    """Smallest id over links of the listed fingerprints, by looking at all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = sorted(set(fps))
    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for f, d in zip(fps, ids, strict=True):
        if d is not None:
            low[find(f)] = min(d, low.get(find(f), d))
    return [low.get(find(f)) for f in fps]


def expected(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    return sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, brute_components(fps, [d for d, _ in rows]), strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    for t in [*HARD, "A B c", "É a b", *(" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (2, 3, 4, 9, 500))]:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_hard_rows_have_their_rows(spark):
    rng = random.Random(5)
    long = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(3000)]
    near = []
    for k in range(12):
        w = list(long)
        w[100 * k] = f"new{k}"
        near.append(" ".join(w))
    texts = [*HARD, *HARD[3:7], *near]
    docs = docs_of(spark, texts, 5)
    rows = [(5 + i, t) for i, t in enumerate(texts)]
    odd = [(None, "lone words without an id here"), (None, ""), (7, "another text of id seven"), (7, None)]
    more = spark.createDataFrame([(d, t, None, None, None) for d, t in odd], DOC)
    clash = docs.unionByName(more).selectExpr("*", "1 AS fp", "'x' AS fingerprint", "2L AS component_id", "3 AS low", "4 AS root")
    assert got(simhash.near_duplicates(clash)) == expected([*rows, *odd])
    assert len({c for _, t, c in got(simhash.near_duplicates(docs_of(spark, near)))}) < len(near)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "limit"), [(2, 1024), (2, 3), (1, 2), (3, 4), (0, 2)])
def test_links_equal_all_pairs(spark, radius, limit):
    """With a small limit, nearly all buckets are split by the second masks."""
    rng = random.Random(radius)
    fps = set()
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            f ^= 1 << rng.randrange(64) if rng.random() < 0.8 else 7 << rng.randrange(60)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    label = {f: f for f in fps}
    pairs = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, radius, limit).collect()]

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[find(b)] = find(a)
    want = brute_components(fps, fps, radius)
    least = {}
    for f in fps:
        least[find(f)] = min(f, least.get(find(f), f))
    assert [least[find(f)] for f in fps] == want
    assert len(pairs) <= 2 * 10 * 10 * len(fps)


def test_near_lanes_equal_bit_counts():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 300):
        base = rng.integers(0, 2**63, 1).astype(np.uint64)
        fps = base ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        p = simhash.planes(fps)
        for shift in (1, 5, 64, 70):
            for radius in (0, 1, 2, 3, 4, 7):
                lanes = np.zeros((p.shape[1] - 2) * 64, bool)
                lanes[: max(0, n - shift)] = True
                words, hit = simhash.near_lanes(p, np.packbits(lanes, bitorder="little").view(np.uint64), shift, radius)
                found = {int(w) * 64 + i for w, h in zip(words, hit, strict=True) for i in range(64) if int(h) >> i & 1}
                assert found == {i for i in range(n - shift) if int(fps[i] ^ fps[i + shift]).bit_count() <= radius}


def test_largest_bucket_is_bounded():
    for m, more in simhash.masks(2):
        assert m.bit_count() >= 38 and len(more) == 10
        assert all(64 - x.bit_count() <= 11 and x & m == m for x in more)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    q = queries.op13_simhash(spark, SF)
    assert dict(q.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    assert got(q) == expected(rows)
