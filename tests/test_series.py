"""Levels at any year against a search in each site's table."""

import bisect
import random

from tarnscape.operators import series


def test_levels_equal_a_search_in_each_table(spark):
    rng = random.Random(2)
    steps, questions = [], []
    for s in range(12):
        years = sorted(rng.sample(range(-2000, 1200, 50), rng.choice([0, 1, 2, 20])))
        steps += [(f"s{s}", y, rng.uniform(0, 40)) for y in years]
    steps += [("s1", y, level + 1) for s, y, level in steps if s == "s1"]  # the lower one counts
    steps += [(None, 5, 1.0), ("s2", None, 1.0), ("s3", 7, None)]
    for i in range(4000):
        s = "s3" if i % 3 == 0 else f"s{rng.randrange(14)}"  # a third asks about one site
        questions.append((i // 2, s if i % 97 else None, rng.choice([rng.randrange(-2500, 1500), rng.randrange(-2000, 1200, 50)]) if i % 89 else None))
    questions += questions[:7]
    table = {}
    for s, y, level in steps:
        if None not in (s, y, level):
            table.setdefault(s, {})[y] = min(level, table.get(s, {}).get(y, 1e9))
    want = []
    for i, s, y in questions:
        level, t = None, sorted(table.get(s, {}).items())
        if y is not None and t:
            k = bisect.bisect_right([a for a, _ in t], y)
            if k in (0, len(t)):
                level = t[max(0, k - 1)][1]
            else:
                (y0, l0), (y1, l1) = t[k - 1], t[k]
                level = l0 if y0 == y else l0 + (l1 - l0) * ((y - y0) / (y1 - y0))
        want.append((i, s, y, level))
    df = spark.createDataFrame(questions, "id long, slug string, year int").selectExpr("*", "-1D AS level")
    some = spark.createDataFrame(steps, "slug string, year int, level double")
    got = [tuple(r) for r in series.levels_at(some, df).select("id", "slug", "year", "level").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = series.levels_at(some.limit(0), df).where("level IS NOT NULL")
    assert none.count() == 0 and series.levels_at(some, df.limit(0)).count() == 0


def test_one_site_spreads_over_tasks(spark):
    steps = spark.createDataFrame([("s", y, float(y)) for y in range(0, 1000, 100)], "slug string, year int, level double")
    df = spark.range(40_000).selectExpr("id", "'s' AS slug", "int(id % 3) + 500 AS year")
    got = series.levels_at(steps, df)
    assert got.where("abs(level - year) > 1e-9").count() == 0 and got.count() == 40_000
