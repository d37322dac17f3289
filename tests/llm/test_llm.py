"""The training-data operators against brute force, on small tables with hard cases."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnscape.llm import ann, decontaminate, langid, license_scan, line_dedup, minhash, mixing, pii, toxicity, warc
from tarnscape.llm.memo import Memo

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


HARD = [None, "", " \n\t ", "word", "word", "a b c d e f", "a b c d e f", "x" * 40_000, ("lorem ipsum " * 4000).strip(), "é ñ ü 😀 日本", "1 2 3", "!!!"]


# ---- line dedup ------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute_lines(rows, least=20):
    lines = [(d, k, x.lower().strip(line_dedup.BLANKS)) for d, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    firsts = {}
    for d, k, s in lines:
        firsts[s] = min(firsts.get(s, (d, k)), (d, k))
    out = {}
    for d, k, s in lines:
        if firsts[s] < (d, k):
            out[d, k] = (*firsts[s], 0)
        elif len(s) >= least:
            near = [at for t, at in firsts.items() if at < firsts[s] and len(t) >= least and one_edit(s, t)]
            if near:
                out[d, k] = (*min(near), 1)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["the quick brown fox jumps over the lazy dog number one", "short", "another line that is long enough to be compared here", "y" * 700 + " end of a long line", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = []
    for i in range(50):
        ls = []
        for _ in range(3):
            x, r = rng.choice(base), rng.random()
            p = rng.randrange(len(x))
            ls.append(x[:p] + rng.choice("abz") + x[p + 1 :] if r < 0.3 else x[:p] + x[p + 1 :] if r < 0.5 else x[:p] + "q" + x[p:] if r < 0.7 else x)
        rows.append((i, "\n".join(ls)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, "Ünï " * 9), (104, "ÜNÏ " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.of_doc_id, r.of_line_no, r.edits) for r in line_dedup.duplicate_lines(df).collect()}
    assert got == brute_lines(rows)


def test_dropping_lines(spark):
    line = "a line that is certainly long enough"
    df = docs_of(spark, [f"{line}\nown", f"x\n{line}", line, None, "", f"{line}!\nkeep\n"]).withColumn("gone", F.lit(1)).withColumn("text_id", F.lit("z"))
    got = {r.doc_id: r for r in line_dedup.drop_duplicate_lines(df).collect()}
    assert {k: r.text for k, r in got.items()} == {0: f"{line}\nown", 1: "x", 3: None, 4: "", 5: "keep\n"}
    assert got[1].n_chars == 1 and got[1].gone == 1 and list(got[1].asDict()) == df.columns


# ---- mixing ----------------------------------------------------------------------------------


def brute_targets(size, cap=3):
    w = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    full, left = {}, sum(size.values())
    while True:
        open_ = [s for s in size if s not in full]
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * size[s]]
        if not over:
            return {**full, **{s: left * w[s] / total for s in open_}}
        full |= {s: cap * size[s] for s in over}
        left = sum(size.values()) - sum(full.values())


def brute_mix(rows, cap=3):
    """Words taken of each row, by one sorted list of packets."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + count(t)
    goal, packets = brute_targets(size, cap), []
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for s in size:
        mine = [(md5(f"mix:{'null' if d is None else d}"), d, count(t), md5(t) if t is not None else "") for d, t, x in rows if x == s]
        at, most = 0, max(1, int(goal[s] / 100))
        queue = [(k, mine.count(k)) for k in sorted(set(mine), key=lambda k: (k[0], k[1] is not None, k[1] or 0, *k[2:]))]
        for r in range(cap):
            at = r * size[s]
            for k, n in queue:
                for lo in range(at, at + k[2] * n, most):
                    if lo < goal[s]:
                        hi = min(lo + most, at + k[2] * n)
                        packets.append((hi / goal[s], s is None, s or "", lo, hi - lo, (s, k), n))
                at += k[2] * n
    left, taken = sum(size.values()), {}
    for *_, words, key, n in sorted(packets, key=lambda p: p[:4]):
        taken[key] = taken.get(key, 0) + min(words, left)
        left -= min(words, left)
    out = []
    for s in size:
        mine = [(md5(f"mix:{'null' if d is None else d}"), d, count(t), md5(t) if t is not None else "") for d, t, x in rows if x == s]
        for k in set(mine):
            n, t = mine.count(k), taken.get((s, k), 0)
            out += [(k[1], k[2], t // n + (i < t % n)) for i in range(n)]
    return goal, size, sorted(out, key=str)


def test_mixing_equals_a_sorted_queue(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(30)), rng.choice(["a", "b", "c", None, "d"] + ["hot"] * 8)) for i in range(400)] + [(900, None, "a"), (901, "  ", "empty"), (901, "  ", "empty"), (902, "x y", "tiny"), (None, "u v w", "b"), (903, "l " * 3000, "c")] + [(904, "s t u", "b")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("level", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash")).withColumn("copies", F.lit("clash"))
    goal, size, want = brute_mix(rows)
    got = mixing.queued(df, rows_per_bucket=25).collect()
    assert sorted(((r.doc_id, r["size"], r.taken) for r in got), key=str) == want
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and 0 <= r.taken <= 3 * r["size"] and abs(r.target - goal[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= max(1, goal[s] / 100) + 1 for s in size) and sum(taken.values()) == sum(size.values())
    again = mixing.queued(df.repartition(7), rows_per_bucket=4000).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in again) == sorted((r.doc_id or 0, r.taken) for r in got)
    entries = mixing.mix(df, rows_per_bucket=50).collect()
    assert sum(r.words for r in entries) == sum(taken.values())
    assert [r.finish for r in entries] == sorted(r.finish for r in entries)
    kept = mixing.mixed_documents(df).collect()
    assert sorted(((r.doc_id, r["size"], r.taken) for r in kept), key=str) == [x for x in want if x[2]]
    assert all(r.level == "clash" == r.copies for r in kept) and set(kept[0].asDict()) == {*df.columns, "source_size", "taken"}
    assert mixing.queued(df.where("doc_id < 0")).count() == mixing.mix(df.where("doc_id < 0")).count() == 0


def test_mixing_many_sources(spark):
    rows = [(i, "w " * (i % 17 + 1), f"host{i % 700}") for i in range(2100)]
    got = mixing.queued(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    goal = brute_mix(rows)[0]
    assert all(abs(r.target - goal[r.source]) < 1e-6 and abs(r.taken - r.target) <= 2 for r in got) and len(got) == 700


# ---- near duplicates -------------------------------------------------------------------------


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(25 if g == 0 else 4):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((at, " ".join(w)))
            at += 1
    rows += [(500, None), (501, ""), (502, "A b C"), (503, "a B c"), (504, " \n"), (505, "a B c"), (505, "a B c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute_near(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    texts = dict(rows)
    assert all(r.n_shingles == len(shingles(texts[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in got)
    kept = sorted(r.doc_id for r in minhash.keep_one(df).collect())
    assert kept == sorted(d for d, c in want.items() if d == c)


def test_setsketch_merges_and_estimates():
    keys = minhash._keys(160)
    memo = Memo(lambda w: hash(w) & (2**64 - 1))
    a = minhash.shingle_hashes(" ".join(f"a{i}" for i in range(300)), memo)
    b = minhash.shingle_hashes(" ".join(f"a{i}" for i in range(30, 330)), memo)
    x, y, both = (minhash.registers(v, 160, keys) for v in (a, b, np.union1d(a, b)))
    assert (np.maximum(x, y) == both).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - true) < 0.15


# ---- WARC ------------------------------------------------------------------------------------


def brute_warc(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        low = first.get(h or "")
        again = low is not None and i != low
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


def test_warc_round_trip_with_magic_in_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a/x", "hello"), (2, None, "hello"), (3, "u", None), (4, "u", ""), (5, "u", f"x {fake} y"), (6, "u", "é€😀 WARC/1.1\r\n"), (7, "u", fake), (8, "u\r\nX: y", "é€😀 WARC/1.1\r\n"), (9, "u", "a\r\n\r\n" * 50), (10, "u", "z" * 90_000), (10, "u", "z" * 90_000), (11, "u", fake * 3 + "WARC/1.1")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("clash"))
    for parts in (1, 3):
        got = warc.archive_pages(df.coalesce(parts)).collect()
        assert all(r.intact for r in got)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_warc(rows)
    assert warc.archive_pages(df.where("page_id < 0")).count() == 0


def test_warc_with_crafted_lengths(spark):
    record = lambda n: f"WARC/1.1\r\nContent-Length: {n}\r\n\r\nx"
    lengths = [-37, -38, -30, -1, 0, 1, 2**62, 2**63 - 1, 2**63, -(2**63), 10**30, "1e3", "", "0x10", 300]
    rows = [(i, "u", "<p>" + record(n)) for i, n in enumerate(lengths)]
    rows += [(100 + i, "u", record(n)) for i, n in enumerate(lengths)] + [(200, "u", "".join(record(-37) for _ in range(30))), (201, "u", "".join(record(1) + "\r\n\r\n" for _ in range(30)))]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)).collect()
    assert all(r.intact for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_warc(rows)


def test_warc_over_many_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = [(i, "u", f"<p>{i % 40}</p>" * (i % 97)) for i in range(300)]
        got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_warc(rows)


# ---- decontamination -------------------------------------------------------------------------


def edit_infix(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        cur = [i + 1]
        for j, b in enumerate(t):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_infix_distance():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert decontaminate.infix_distance(p, t)[0] == edit_infix(p, t)


def test_contamination_finds_edited_items_only(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(8)] + [(90, None), (91, " "), (92, "two words")]
    docs, want = [], set()
    for d in range(60):
        text = " ".join(word() for _ in range(rng.randint(5, 80)))
        if d % 3 == 0:
            i, t = items[rng.randrange(8)]
            t = list(t.upper() if d % 2 else t)
            for _ in range(d % 4 * 3):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            text = text[: len(text) // 2] + " " + "".join(t) + "\n " + text[len(text) // 2 :]
            want.add((d, i))
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "xx two  words")]
    want.add((102, 92))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 300):  # the second takes several passes
        got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(df, bench, block_chars=block).collect()}
        assert got == want
    assert {r.doc_id for r in decontaminate.clean_documents(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def edited(rng, t, many):
    """t with so many random edits, an equal share of each kind."""
    t = list(t)
    for e in range(many):
        at = rng.randrange(len(t))
        if e % 3 == 0:
            t[at] = rng.choice("abcdefghijklmnopz")
        elif e % 3 == 1:
            t.insert(at, rng.choice("abcdefghijklmnopz"))
        else:
            del t[at]
    return "".join(t)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
def test_recall_against_brute_force(spark, share):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 4, 8, 8, 14, 14, 20, 20, 30, 45)]
    texts = [None, " ", "é 😀"]
    for t in items * 5:
        around = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(2)]
        texts.append(f"{around[0]} {edited(rng, t, int(share * len(t)))} {around[1]}")
    df, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contamination(df, bench).collect()}
    brute = {(n, i): edit_infix(p, " ".join((t or "").split())) for n, t in enumerate(texts) for i, p in enumerate(items)}
    want = {k: d for k, d in brute.items() if d <= int(0.2 * len(items[k[1]])) and (texts[k[0]] or "").strip()}
    assert got.items() <= want.items()
    print(share, len(got), len(want))
    assert len(got) >= 0.9 * len(want)


def test_edits_in_every_third_word_are_found(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9)))
    item = [word() for _ in range(24)]
    texts = []
    for _ in range(30):
        w = [x[:-1] + "z" if k % 3 == 1 else x for k, x in enumerate(item)]
        texts.append(" ".join([*(word() for _ in range(rng.randint(0, 40))), *w, *(word() for _ in range(5))]))
    df, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontaminate.contamination(df, bench).count() >= 27


def test_phrases_that_all_items_and_texts_share(spark):
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    lead = "which of the following answers to the question below is the best one choose a letter"
    items = [(i, f"{lead} {word()} {word()} {word()} {word()} {word()} {word()} {word()} {word()}") for i in range(300)] + [(900, "ha " * 400)]
    texts = [(d, " ".join([lead] * 20 + [word() for _ in range(30)])) for d in range(20)] + [(50, f"so {items[7][1]} on"), (51, "ha " * 5000), (52, "ha " * 390), (53, "ha " * 100)]
    old, decontaminate.PAIRS = decontaminate.PAIRS, 5000
    try:
        bench = decontaminate.Bench([i for i, _ in items], [t for _, t in items])
        got = {(texts[n][0], bench.ids[i]) for n, i, _, _ in decontaminate.hits_of([t for _, t in texts], bench)}
    finally:
        decontaminate.PAIRS = old
    assert got == {(50, 7), (51, 900), (52, 900)}


def test_a_very_long_item(spark):
    rng = random.Random(18)
    item = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(14_000))
    far = item[:50_000] + "q" + item[50_004:]
    df = spark.createDataFrame([(1, "so " + far + " on"), (2, item[:40_000])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = decontaminate.contamination(df, spark.createDataFrame([(7, item), (8, "")], "item_id long, text string").withColumn("doc_id", F.lit(1)), block_chars=1000).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(1, 7, 4)]


# ---- nearest neighbours ----------------------------------------------------------------------


def brute_nearest(rows, ask, k):
    out = {}
    for q, v in rows:
        if q in ask:
            s = sorted((-float((np.array(v, float) * np.array(x, float)).sum()), i) for i, x in rows if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_nearest_with_full_recall_equals_brute_force_and_breaks_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(80)]
    rows = [r for r in rows if any(r[1])] + [(200, rows[1][1]), (201, rows[1][1])]
    bad = [(300, None), (301, [0.0] * 6), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {}
    df = df.withColumn("score", F.lit("clash")).withColumn("v", F.lit("clash"))
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=5, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 5)
    assert ann.nearest(df.where("vec_id < 0"), df).count() == ann.nearest(df, df.where("vec_id < 0")).count() == 0
    few = df.where("vec_id < 9")
    assert ann.nearest(few, few.where("vec_id = 0"), k=20).count() == few.where("vec_id != 0").count()


def test_nearest_recall_with_hashing(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)) + 1.5 * rng.normal(size=(10, 64))[rng.integers(0, 10, 3000)]
    x[:900] = x[0] + 0.01 * rng.normal(size=(900, 64))  # a hot bucket, split into blocks
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), k=20, block=256).toPandas()
    s = x[::50] @ x.T
    s[np.arange(60), np.arange(0, 3000, 50)] = -9
    best = {q * 50: set(np.argsort(-s[q])[:20]) for q in range(60)}
    assert np.mean([len(best[q] & set(g["vec_id"])) / 20 for q, g in got.groupby("query_id")]) >= 0.9
    assert (got.groupby("query_id").size() == 20).all()


def test_nearest_recall_on_vectors_of_mixed_lengths(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2500, 64))
    x *= (rng.lognormal(0, 0.6, 2500) / np.linalg.norm(x, axis=1))[:, None]
    x[7] *= 1e6  # one far longer than all others
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::50] @ x.T
    s[np.arange(50), np.arange(50) * 50] = -np.inf
    want = np.argsort(-s, axis=1)[:, :10]
    assert sum(len(got[50 * q] & set(w.tolist())) for q, w in enumerate(want)) / want.size > 0.93


def test_copies_of_a_vector_id_take_one_place_in_a_block(spark):
    rows = [(1, [1.0, 0.1])] * 30 + [(i, [1.0, 0.1 + i / 1000]) for i in range(2, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id) for r in ann.nearest(df, spark.createDataFrame([(99, [1.0, -0.1])], df.schema), k=5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


# ---- learned operators -----------------------------------------------------------------------


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).where((F.crc32(F.col("doc_id").cast("string")) % 3 == 1) & (F.length("text") > 80))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    hard = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(docs_of(spark, HARD), langid.train(docs)).collect()}
    assert all(hard[i] == ("und", 0.0) for i in (0, 1, 2, 10, 11)) and all(hard[i][0] != "und" for i in (3, 5, 7, 9))
    assert langid.identify(docs_of(spark, ["text"]).where("doc_id < 0")).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(1)
    spoken = []
    for k in range(150):  # each with its own syllables
        syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)]
        spoken += [(1000 * k + i, " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(25)), f"q{k:03d}", None, 1) for i in range(40)]
    docs = spark.createDataFrame(spoken, DOC).repartition(4)
    model = langid.train(docs)
    assert len(model.langs) == 150
    got = langid.identify(docs.withColumn("lang_pred", F.lit("clash")), model).where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def test_votes_equal_a_plain_count(spark):
    rng = np.random.default_rng(5)
    x = rng.random((90, langid.DIMS)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = langid.Model(x, ["de", "en", "nl", "fr", "es", "xx"] * 15)
    names, score = m.predict(x[:20])
    for r in range(20):
        raw = np.exp((x[r] @ m.fw + m.fb).astype(float))
        f = int(raw.argmax())
        member, wins, least = m.members[f], {}, {}
        for k, (g, i, j) in enumerate(m.pairs):
            if g == f:
                p = 1 / (1 + np.exp(-((x[r] @ m.w[k] + m.rest[k, 0]) * m.rest[k, 1] + m.rest[k, 2])))
                for side, c in ((i, p), (j, 1 - p)):
                    wins.setdefault(side, []).append(c)
                    least[side] = min(least.get(side, 1.0), c)
        best = max(range(len(member)), key=lambda i: (sum(c >= 0.5 for c in wins.get(i, [])), sum(wins.get(i, [0.0])), -i))
        assert names[r] == m.langs[member[best]] and abs(score[r] - raw[f] / raw.sum() * least.get(best, 1.0)) < 1e-4


def test_unknown_text_goes_and_known_text_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = ["пример текста на русском языке", "これは日本語の文章です", "12 34", None, ""]
    mixed = docs.unionByName(docs_of(spark, odd, 10**9)).withColumn("lang_score", F.lit("clash"))
    kept = langid.known_language(mixed)
    assert kept.columns == mixed.columns and kept.where("doc_id >= 1000000000").count() == 0
    assert kept.count() >= 0.995 * docs.count()


def test_blocks_of_a_long_text_give_the_same_features():
    t = "Der Hund, die Katze  und\n das Haus. " * 50
    assert np.allclose(langid.features(t), langid.features(t, block=37), atol=1e-6)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    held = toxicity.scored(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    r = held.agg(F.avg(F.when(F.col("toxic") == 1, (F.col("toxic_score") >= 0.5).cast("int"))).alias("hit"), F.avg(F.when(F.col("toxic") == 0, (F.col("toxic_score") >= 0.5).cast("int"))).alias("false")).first()
    assert r["hit"] > 0.8 and r["false"] < 0.03
    s = [x.toxic_score for x in toxicity.scored(docs_of(spark, HARD), model).orderBy("doc_id").collect()]
    assert all(0 <= x <= 1 for x in s) and s[0] == s[1] == s[2] and len(s) == len(HARD)


def test_factorization_learns_a_pair():
    rng = random.Random(0)
    docs, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append(np.array(sorted([5] * a + [9] * b + rng.sample(range(100, 160), 5)), np.int32))
        y.append(float(a and b))
    m = toxicity.Machine(docs, np.array(y), epochs=12)
    assert np.mean([(m.score(list(d)) >= 0.5) == (t > 0) for d, t in zip(docs, y, strict=True)]) > 0.97
    assert m.v[m.place[5]] @ m.v[m.place[9]] > 0.1


def test_a_pair_without_linear_signal_is_learned():
    def sample(n, seed):
        rng, docs, y = random.Random(seed), [], []
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            docs.append(np.array(sorted([5] * a + [9] * b + rng.sample(range(100, 160), 5)), np.int32))
            y.append(float(a != b))
        return docs, np.array(y)

    m = toxicity.tuned(*sample(4000, 1), np.arange(4000) % 4 == 0)
    docs, y = sample(1000, 2)
    assert np.mean([(m.score(list(d)) >= 0.5) == (t > 0) for d, t in zip(docs, y, strict=True)]) > 0.95


def test_score_equals_a_double_loop_over_pairs():
    rng = random.Random(7)
    docs = [np.array(sorted(rng.sample(range(60), rng.randint(0, 12))), np.int32) for _ in range(600)]
    m = toxicity.Machine(docs, np.array([float(3 in d and 8 in d or 20 in d) for d in docs]))
    for d in docs[:100]:
        known = [m.place[t] for t in d.tolist() if t in m.place]
        raw = m.w0 + sum(m.w[i] for i in known) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(known, 2))
        assert abs(m.score(d.tolist()) - 1 / (1 + np.exp(-raw))) < 1e-9


def test_training_on_repeated_rows_equals_training_on_distinct_ones(spark):
    rows = [(i, ("you fool " if i % 2 else "good day ") + f"w{i % 9} and more words here", "en", "s", 9) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, 1, i % 2) for i in range(300)] + [(5, 1, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.unionByName(docs.where("doc_id % 3 = 0")).withColumn("toxic", F.lit("clash")), labels.unionByName(labels))
    assert a.place == b.place and np.allclose(a.w, b.w) and np.allclose(a.v, b.v)
    assert {r.toxic_score > 0.5 for r in toxicity.scored(docs.where("doc_id % 2 = 1").withColumn("toxic_score", F.lit("clash")), a).collect()} == {True}


# ---- personal data ---------------------------------------------------------------------------


def brute_base(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice("ab1209.@@-+ (é%") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute_base(t), t
    for t in ("card 4111 1111 1111 1111, 4111-1111-1111-1112", "0000.1.2.0255 1.2.3.256", "a@b a@b.c@d.e", "+1 (375) 555-4393"):
        assert pii.base_spans(t) == brute_base(t), t
    assert pii.base_spans("1" * 100_000 + "@" + "a" * 100_000) == brute_base("") == []


def test_viterbi_equals_enumeration():
    rng = random.Random(2)
    field = pii.Field(pii.labelled_rows(), steps=20)
    tagger = pii.Tagger(field)
    words = ["call", "555-222-8899", "at", "bob", "gmail", "dot", "com", "x" * 300, "1" * 200, "house", "192.168.1.9", "4111", "a@b.c"]
    lines = [[rng.choice(words) for _ in range(rng.randint(1, 4))] for _ in range(40)]
    for line, tags in zip(lines, tagger.decode(lines), strict=True):
        w = [field.weights(pii.shape(x)) for x in line]

        def score(y, w=w):
            total = sum(w[i][1][y[i]] + (w[i - 1][0][y[i]] if i else field.e[0, -1, y[i]]) + (w[i + 1][2][y[i]] if i + 1 < len(w) else field.e[2, -1, y[i]]) for i in range(len(w)))
            return total + sum(field.t[a, b] for a, b in zip(y, y[1:])) - 1e4 * (y[0] > 0 and y[0] % 2 == 0)

        best = max(itertools.product(range(pii.LABELS), repeat=len(line)), key=score)
        assert abs(score(tuple(tags)) - score(best)) < 1e-3


def test_shapes_read_whole_words():
    assert pii.shape("a" * 200 + "@x.org") != pii.shape("a" * 200 + ".x.org")
    assert pii.shape("-" * 90 + "12")[2] == 2 and pii.shape("x-" * 60 + "12345")[-1] != pii.shape("x-" * 60)[-1]


def test_rules_after_the_field():
    assert pii._enough(0, "bob at gmail dot com") and not pii._enough(0, "gmail.com")
    assert pii._enough(1, "2001:db8:0:0:8:800:200c:417a") and not pii._enough(1, "1.2.3") and not pii._enough(1, "a:b:c:d")
    assert pii._enough(2, "4111.1111.1111.1111") and not pii._enough(2, "4111.1111.1111.1112")
    assert pii._enough(3, "555-222-8899") and not pii._enough(3, "1894") and not pii._enough(3, "1" * 16)


def test_field_adds_spans_and_leaves_clean_text_alone(spark):
    clean = ["the house of 1894 has 45 rooms", "password=e3b3ed3cc8548923d6", "ein Haus am Meer", "x", *[t for t in HARD]]
    more = ["please call 555-222-8899 tonight", "write bob at gmail dot com now", "call +1 (375) 555-4393 now"]
    got = {r.doc_id: r for r in pii.find_pii(docs_of(spark, clean + more).withColumn("spans", F.lit("clash")).withColumn("n_ip", F.lit("clash")).withColumn("kind", F.lit("clash"))).collect()}
    n = len(clean)
    assert all(got[i].spans == "" and got[i].base_sha256 == hashlib.sha256(b"").hexdigest() for i in range(n))
    assert got[n].spans == "phone:12:24" and got[n].n_phone == 0 and got[n].n_added == 1
    assert got[n + 1].spans.startswith("email:6:") and got[n + 2].spans == "phone:5:22" and got[n + 2].n_phone == 1


# ---- licences --------------------------------------------------------------------------------


def test_licences_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("a/LICENSE", mit), ("a/x.py", "code"), ("a/b/c/y.py", "code"), ("a/b/LICENSE.txt", gpl), ("a/b/z.py", f"# {mit}\ncode"), ("d/w.py", "code"), (None, "code"), ("a/n.py", None), ("top", ""), ("a/x.py", "code"), ("a/long.py", "word " * 9000 + f"\n<p>{gpl}</p>")]
    df = spark.createDataFrame(rows, "path string, text string")
    for c in ("own", "cosine", "licence", "row", "up", "of", "key"):
        df = df.withColumn(c, F.lit("clash"))
    found = license_scan.scan(df).collect()
    assert all(r.own == r.row == r.up == r.of == r.key == "clash" for r in found)
    got = sorted(((r.path or "", r.licence or "", r.inherited, r.from_dir or "") for r in found))
    assert got == sorted([("a/LICENSE", "MIT", False, ""), ("a/x.py", "MIT", True, "a"), ("a/x.py", "MIT", True, "a"), ("a/b/c/y.py", "GPL-3.0", True, "a/b"), ("a/b/LICENSE.txt", "GPL-3.0", False, ""), ("a/b/z.py", "MIT", False, ""), ("d/w.py", "", False, ""), ("", "", False, ""), ("a/n.py", "MIT", True, "a"), ("top", "", False, ""), ("a/long.py", "GPL-3.0", False, "")])
    assert license_scan.scan(df.where("path = 'none'")).count() == 0


def test_a_deep_path_inherits(spark):
    deep = "/".join(f"d{i}" for i in range(3000))
    rows = [(f"{deep}/x.py", "code"), ("d0/d1/LICENSE", "Released under the MIT License.")]
    got = {r.path: (r.licence, r.from_dir) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got[f"{deep}/x.py"] == ("MIT", "d0/d1")


def brute_scan(rows, least=0.6):
    """Licences by dense cosines over all segments, and inheritance by walking up each path."""
    frequency = {}
    for _, t in rows:
        for w in set(license_scan.VOCABULARY) & set(license_scan.terms(t or "")):
            frequency[w] = frequency.get(w, 0) + 1
    n = sum(t is not None for _, t in rows)
    texts = {name: [*fs, *([license_scan.WHOLE[name]] if name in license_scan.WHOLE else [])] for name, fs in license_scan.TEMPLATES.items()}
    have = {w: sum(any(w in license_scan.terms(f) for f in fs) for fs in texts.values()) for w in license_scan.VOCABULARY}
    idf = lambda w: (np.log((1 + n) / (1 + frequency.get(w, 0))) + 1) * (np.log((1 + len(texts)) / (1 + have[w])) + 1) if w in have else np.log((1 + n) / 2) + 1

    def cosine(a, b):
        x, y = ({w: t.count(w) * idf(w) for w in t} for t in (license_scan.terms(a), license_scan.terms(b)))
        size = lambda v: np.sqrt(sum(z * z for z in v.values()))
        return sum(z * y.get(w, 0) for w, z in x.items()) / size(x) / size(y) if x and y else 0.0

    def told(near, top):
        """The nearest licence; none if another is as near; the one that contains it if that is found too."""
        m, name = max(near.values()), min(k for k, v in near.items() if v >= max(near.values()) - 1e-12)
        if name == "BSD-2-Clause" and top.get("BSD-3-Clause", 0) >= 0.9 * m:
            return "BSD-3-Clause", top["BSD-3-Clause"]
        others = [k for k, v in near.items() if k != name and v >= m - license_scan.MARGIN and (k, name) != ("BSD-2-Clause", "BSD-3-Clause")]
        return (None if others else name), m

    def own(path, text):
        near = lambda t, forms: {k: max(cosine(t, f) for f in fs) for k, fs in forms.items()}
        if path is not None and re.search(license_scan.LICENCE_FILE, path) and text:
            whole = near(text, texts)
            name, m = told(whole, {})
            if m >= least:
                return name
        segments = [near(seg, license_scan.TEMPLATES) for seg in license_scan.segments(text)]
        if not segments:
            return None
        best = segments[0]
        for seg in segments[1:]:
            if max(seg.values()) > max(best.values()) + 1e-12:
                best = seg
        name, m = told(best, {k: max(seg[k] for seg in segments) for k in best})
        return name if m >= least else None

    mine = [own(p, t) for p, t in rows]
    dirs = {}
    for (p, _), m in zip(rows, mine, strict=True):
        if m and p is not None and re.search(license_scan.LICENCE_FILE, p):
            dirs.setdefault(p.rpartition("/")[0], []).append(m)
    dirs = {d: min(v, key=lambda m: (-v.count(m), m)) for d, v in dirs.items()}
    out = []
    for (p, _), m in zip(rows, mine, strict=True):
        up = None
        while m is None and p is not None and up is None:
            p = p.rpartition("/")[0]
            up = p if p in dirs else None
            if not p:
                break
        out.append((m or dirs.get(up), up))
    return out


def test_whole_scan_equals_brute_force(spark):
    rng = random.Random(4)
    notices = [f for fs in license_scan.TEMPLATES.values() for f in fs]
    rows = []
    for i in range(120):
        parts = [rng.choice(["a", "b", "c"]) for _ in range(rng.randint(0, 4))] + [rng.choice(["LICENSE", "x.py", "COPYING.md", f"f{i}.c"])]
        w = rng.choice(notices).split()
        for _ in range(rng.choice([0, 0, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(["foo", "the", "license", "bar"])
        text = "\n".join([rng.choice(["code()", "# " + " ".join(w), " ".join(w[: len(w) // 2]) + "\n * " + " ".join(w[len(w) // 2 :])]) for _ in range(rng.randint(0, 3))])
        rows.append(("/".join(parts), text or None))
    want = brute_scan(rows)
    got = license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted(((r.path, r.licence or "", r.from_dir or "") for r in got), key=str) == sorted(((p, m or "", up or "") for (p, _), (m, up) in zip(rows, want, strict=True)), key=str)


def test_cosine_equals_dense_arithmetic():
    t = license_scan.Templates({"license": 5, "the": 50}, 100)
    seg = "Licensed under the Apache License, Version 2.0."
    v, norm = t.vector(seg)
    best = 0
    for forms in license_scan.TEMPLATES.values():
        for f in forms:
            u, m = t.vector(f)
            best = max(best, sum(v.get(k, 0) * x for k, x in u.items()) / norm / m)
    assert t.best(seg)[0] == "Apache-2.0" and abs(t.best(seg)[1] - best) < 1e-9


def test_notices_over_markup_and_wrapped_lines():
    t = license_scan.Templates({"license": 5, "the": 50, "version": 9}, 100)
    assert t.best('<p>Licensed under the <a href="/l">Apache License</a>, <b>Version</b> 2.0.</p>')[0] == "Apache-2.0"
    assert t.best('<p>Licensed under the <a href="/l">Apache License</a>, <b>Version</b> 2.0.</p>')[1] > 0.99
    for n, name in ((2, "GPL-2.0"), (3, "GPL-3.0")):
        mark = ";:"[n - 2]
        head = f" * This program is free software{mark} you can\n * redistribute it and/or modify\n * it under the terms of the GNU General\n * Public License{', version' if n == 3 else '; version'}\n * {n}\n"
        assert t.best("int x = 1;\n/*\n" + head + " */\nint y;")[0] == name and t.best(head)[1] > 0.9
    # no line of its own has a cue, and one cue is cut by a line end
    mit = "to any person\nobtaining a copy of this software\nand associated documentation files, to deal\nin the Software without\nrestriction"
    assert t.best(mit)[0] == "MIT" and t.best(mit)[1] >= 0.6
    for name, text in license_scan.WHOLE.items():
        w = f"Copyright (c) 2020 Somebody {text}".split()
        assert t.best("\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)), file=True)[0] == name


# ---- hard tables for all ---------------------------------------------------------------------


@pytest.mark.parametrize("run", [lambda d, b: line_dedup.drop_duplicate_lines(d), lambda d, b: minhash.keep_one(d), lambda d, b: decontaminate.clean_documents(d, b), lambda d, b: mixing.mixed_documents(d), lambda d, b: toxicity.scored(d, toxicity.Machine([], np.empty(0))), lambda d, b: pii.find_pii(d), lambda d, b: langid.identify(d)])
def test_nulls_empties_and_long_texts(spark, run):
    df = docs_of(spark, HARD).union(spark.createDataFrame([(None, None, None, None, None), (3, "word", "en", None, 4)], DOC)).withColumn("c", F.lit("clash")).withColumn("h", F.lit(2))
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    out = run(df, bench)
    assert {"doc_id", "text", "c", "h"} <= set(out.columns)
    assert 0 < out.count() <= len(HARD) + 2
    assert run(df.where("doc_id < 0"), bench).count() == 0
