"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnscape.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: A packet holds this share of its source's target at most, so a source ends that near to it.
PACKETS = 100


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds for each name the sum of its column over all rows that come before, in an order without ties.

    Rows are dealt out by ranges of the order. A table of one row a range has the sums of
    whole ranges, and each task sums its own range, so no task holds all rows."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranged = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    total = [F.coalesce(F.sum(n).over(before(Window.orderBy("__range"))), F.lit(0)).alias(f"__{n}") for n in sums]
    per = ranged.groupBy("__range").agg(*[F.sum(v).alias(n) for n, v in sums.items()]).select(F.col("__range").alias("__r"), *total)
    inner = before(Window.partitionBy("__range").orderBy(*order))
    out = ranged.join(F.broadcast(per), F.col("__range") == F.col("__r"))
    return out.select(*rows.columns, *[(F.coalesce(F.sum(v).over(inner), F.lit(0)) + F.col(f"__{n}")).alias(n) for n, v in sums.items()])


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(source, source_size, target): words that each source gives to the mix, from (source, source_size).

    Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the words
    of all of them; a target ends at ``cap`` times its source's size, and what is over goes
    to the others by weight until no target is above. In closed form: sorted by cap/weight,
    the first k sources are full, where k is the least number for which the level of the
    others stays under the next one's cap/weight. There may be as many sources as hosts:
    ranks and running sums go over ranges, and the level is the least of one aggregate."""
    named = [F.col("source").isNull(), F.col("source")]
    by = running(sizes, named, rank=F.lit(1)).select("source", "source_size", (F.col("rank") % 3 + 1).cast("long").alias("w"))
    full = (F.col("source_size") * cap).cast("double")
    whole = by.agg(F.sum("source_size").alias("words"), F.sum("w").alias("weight")).first()
    by = running(by, [full / F.col("w"), *named], fuller=F.col("source_size"), weight=F.col("w"))
    level = (F.lit(whole["words"]) - cap * F.col("fuller")).cast("double") / (F.lit(whole["weight"]) - F.col("weight")).cast("double")
    by = by.withColumn("level", level)
    # the first source in order that isn't full sets the level of all; of equal ones, the first has the highest
    first = by.where(F.col("level") * F.col("w") <= full).agg(F.min(F.struct((full / F.col("w")).alias("at"), (-F.col("level")).alias("less"))).alias("x")).first()["x"]
    target = full if first is None else F.least(full, F.lit(-first["less"]) * F.col("w"))
    return by.select("source", "source_size", target.alias("target"))


def _lines(docs: DataFrame, seed: str) -> DataFrame:
    """(doc_id, source, size, hash, text_hash, copies): equal rows as one, from one reading of the texts."""
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    slim = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), h.alias("hash"), F.coalesce(F.md5("text"), F.lit("")).alias("text_hash"))
    return cut(slim.groupBy("doc_id", "source", "size", "hash", "text_hash").agg(F.count(F.lit(1)).alias("copies")), "sizes")


def _queue(docs: DataFrame, seed: str, rows_per_bucket: int, cap: int) -> tuple[DataFrame, int, int]:
    """A written table with a row for each distinct document and the words before it in its source; the total budget; the number of ranges."""
    rows = _lines(docs, seed)
    sizes = cut(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), "sources")
    goal = targets(sizes, cap).withColumnRenamed("source", "__g")
    budget = sizes.agg(F.sum("source_size").alias("words")).first()["words"] or 0
    many, hexits = rows.count(), 1
    while 16**hexits * rows_per_bucket < many:
        hexits += 1
    rows = rows.withColumn("bucket", F.substring("hash", 1, hexits)).withColumn("length", F.col("size") * F.col("copies"))
    per = rows.groupBy(F.col("source").alias("__s"), F.col("bucket").alias("__b")).agg(F.sum("length").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("__ahead", ahead).join(goal, F.expr("__s <=> __g")).drop("__g", "__n")
    inner = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("length").over(inner), F.lit(0))).join(per, F.expr("source <=> __s AND bucket = __b"))
    rows = rows.withColumn("before", F.col("__ahead") + F.col("__in")).drop("__ahead", "__in", "__s", "__b", "bucket")
    return cut(rows, "queue"), int(budget), max(1, many // rows_per_bucket)


def _packets(cap: int) -> Column:
    """All packets of a row of the queue that start before virtual time 1: from word lo to word hi of its source's repeated queue."""
    most = f"greatest(1L, bigint(floor(target / {PACKETS})))"
    start = "(r * source_size + before)"
    many = f"least(bigint(ceil(length / {most})), bigint(ceil((target - {start}) / {most})))"
    packet = f"struct({start} + i * {most} AS lo, {start} + least(length, (i + 1) * {most}) AS hi)"
    rounds = f"transform(sequence(0L, {cap - 1}L), r -> CASE WHEN length > 0 AND {many} > 0 THEN transform(sequence(0L, {many} - 1), i -> {packet}) ELSE array() END)"
    return F.expr(f"filter(flatten({rounds}), p -> p.lo < target)")


def _range_of(hi: Column, ranges: int) -> Column:
    return F.floor(hi / F.col("target") * ranges).cast("long")


def _truncated(queue: DataFrame, budget: int, ranges: int, cap: int) -> tuple[DataFrame, int]:
    """The packets of the range of finish times in which the budget ends, with the words taken of each; and that range.

    All packets fall into ranges of finish times. A table with a row for each range has the
    running words. The one in which they reach the budget has a packet of every source, as all
    of them end at virtual time 1; so it is sorted and summed over ranges of its own (see
    running), and cut where the budget ends."""
    each = queue.select("*", F.explode(_packets(cap)).alias("p")).select(*queue.columns, "p.lo", "p.hi", (F.col("p.hi") - F.col("p.lo")).alias("words"), (F.col("p.hi") / F.col("target")).alias("finish"))
    per = cut(each.groupBy(_range_of(F.col("hi"), ranges).alias("range")).agg(F.sum("words").alias("words")), "ranges")
    total = per.withColumn("after", F.sum("words").over(Window.orderBy("range")))
    last = total.where(F.col("after") >= budget).agg(F.min(F.struct("range", "after", "words")).alias("x")).first()["x"]
    if last is None:  # nothing is queued, or the last words are lost to rounding
        return each.where("false").withColumn("taken", F.lit(0).cast("long")), 2**62
    edge = each.where(_range_of(F.col("hi"), ranges) == last["range"])
    edge = running(edge, [F.col("finish"), F.col("source").isNull(), F.col("source"), F.col("lo")], __ahead=F.col("words"))
    left = F.lit(budget - (last["after"] - last["words"])) - F.col("__ahead")
    return edge.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), left)).cast("long")).drop("__ahead"), last["range"]


def _key(side: str = "") -> list[str]:
    return [f"{side}{c}" for c in ("doc_id", "source", "size", "text_hash")]


def _taken(docs: DataFrame, seed: str, rows_per_bucket: int, cap: int) -> DataFrame:
    """The queue with taken: the words that the mix takes of a document and its copies."""
    queue, budget, ranges = _queue(docs, seed, rows_per_bucket, cap)
    edge, stop = _truncated(queue, budget, ranges, cap)
    part = cut(edge.groupBy(*_key()).agg(F.sum("taken").alias("part")), "edge").withColumnsRenamed({c: f"__{c}" for c in _key()})
    none = F.lit(0).cast("long")
    whole = F.aggregate(_packets(cap), none, lambda t, p: t + F.when(_range_of(p["hi"], ranges) < stop, p["hi"] - p["lo"]).otherwise(none))
    same = F.expr(" AND ".join(f"{c} <=> __{c}" for c in _key()))
    return queue.withColumn("whole", whole).join(part, same, "left").withColumn("taken", F.col("whole") + F.coalesce("part", none)).drop("whole", "part", *_key("__"))


def queued(docs: DataFrame, seed: str = "mix", rows_per_bucket: int = 20_000, cap: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): a row for each row of docs.

    Each source's documents stand in a shuffled order, by md5 of seed and doc_id (ties: by
    size, then by a hash of the text), and the queue repeats up to ``cap`` times. It is
    served in packets: documents, or parts of long ones, of at most a hundredth of the
    source's target. A packet's virtual finish time is the words of its source up to its end
    over the source's target. All packets that start before virtual time 1 are range-sorted
    by finish time (ties: source, then place) and truncated at the total budget, the words of
    all documents; the last packet is cut. So a source ends within a packet of its target.

    The running word count of a source is a sum over buckets of the shuffled order plus a sum
    in a bucket, and the running count of the mix a sum over ranges of finish times plus one
    over ranges of the last of these, so a source with a third of all rows spreads over many tasks. Null texts
    and sources without words give 0; a null source is a source of its own, and comes last.
    Equal rows (doc_id, source, text) share their words evenly, to a word. Columns other than
    doc_id, source and text aren't read."""
    one = _taken(docs, seed, rows_per_bucket, cap).withColumn("k", F.explode(F.expr("sequence(0L, copies - 1)")))
    share = F.floor(F.col("taken") / F.col("copies")) + (F.col("k") < F.col("taken") % F.col("copies")).cast("long")
    return one.select("doc_id", "source", "size", "source_size", "target", share.cast("long").alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", rows_per_bucket: int = 20_000, cap: int = 3) -> DataFrame:
    """(doc_id, source, finish, words): the packets of the mix in its order, range-sorted by finish time.

    Each stretch of the output has the sources near their target weights."""
    queue, budget, ranges = _queue(docs, seed, rows_per_bucket, cap)
    edge, stop = _truncated(queue, budget, ranges, cap)
    each = queue.select("doc_id", "source", "target", F.explode(_packets(cap)).alias("p")).where(_range_of(F.col("p.hi"), ranges) < stop)
    each = each.select("doc_id", "source", (F.col("p.hi") / F.col("target")).alias("finish"), "p.lo", (F.col("p.hi") - F.col("p.lo")).alias("words"))
    last = edge.select("doc_id", "source", "finish", "lo", F.col("taken").alias("words")).where("words > 0")
    return each.unionByName(last).orderBy("finish", F.col("source").isNull(), "source", "lo").drop("lo")


def mixed_documents(docs: DataFrame, seed: str = "mix", rows_per_bucket: int = 20_000, cap: int = 3) -> DataFrame:
    """The documents of which the mix takes words (see queued), with size, source_size, target and taken.

    All columns of docs stay; those that have one of these four names are replaced."""
    got = _taken(docs, seed, rows_per_bucket, cap).where("taken > 0").select(*[F.col(c).alias(f"__{c}") for c in (*_key(), "copies", "source_size", "target", "taken")])
    got = cut(got, "taken")
    # rows travel as one column each, so no column of theirs can clash
    rows = docs.select("doc_id", "source", F.coalesce(F.md5("text"), F.lit("")).alias("h"), F.struct(*docs.columns).alias("row"))
    j = rows.join(got, F.expr("doc_id <=> __doc_id AND source <=> __source AND h = __text_hash"))
    share = F.floor(F.col("__taken") / F.col("__copies"))
    if got.where("__taken % __copies > 0").isEmpty():
        j = j.withColumn("__n", share)
    else:  # equal rows are numbered, and the first ones take a word more
        one = Window.partitionBy("__doc_id", "__source", "__text_hash").orderBy(F.xxhash64("row"))
        more = j.where("__taken % __copies > 0").withColumn("__n", share + (F.row_number().over(one) <= F.col("__taken") % F.col("__copies")).cast("long"))
        j = j.where("__taken % __copies = 0").withColumn("__n", share).unionByName(more)
    made = {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "taken": F.col("__n").cast("long")}
    return j.where("__n > 0").select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made], *[v.alias(k) for k, v in made.items()])
