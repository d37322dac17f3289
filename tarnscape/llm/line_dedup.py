"""Line dedup by a deletion-neighbourhood join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscape.session import cut

NO_ID = -(2**63)
#: Characters of a line's segment. Shorter ones give fewer variants and more keys.
SEGMENT = 256
#: Bits of the filter that keeps lines out of a shuffle: for each place, and at least and at most (2 million rows of 64 bits).
FILTER_BITS = (8, 1 << 16, 1 << 27)


#: Cut off at both ends of a line before it is compared.
BLANKS = " \t\r\x0b\x0c\xa0"


def lines_of(docs: DataFrame) -> DataFrame:
    """(at, s): the place (doc_id, line, text hash) and the normal form of every line that isn't blank.

    Normal form: lower case, without blanks at the ends."""
    # explode_outer: an inner one makes Spark infer filters that compute its input twice over
    split = docs.where(F.col("text").isNotNull()).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t"), F.split(F.lower("text"), "\n", -1).alias("ls")
    )
    each = split.select("d", "t", F.posexplode_outer("ls").alias("l", "line"))
    return each.select(F.struct("d", "l", "t").alias("at"), F.btrim("line", F.lit(BLANKS)).alias("s")).where("s != ''")


def _segments(segment: int, min_chars: int, made: str) -> Column:
    """For a line s of n characters, as the longer or shorter of a pair: one item for each segment."""
    parts = f"greatest(2, ceil(m / {segment}))"
    lo, hi = "int(floor(p * m / parts))", "int(floor((p + 1) * m / parts))"
    key = f"xxhash64(m, p, substring(s, 1, {lo}), substring(s, n - (m - {hi}) + 1, m - {hi}))"
    item = made.format(key=key, seg=f"substring(s, {lo} + 1, {hi} - {lo} + n - m)")
    for name, value in (("parts", f"int({parts})"),):
        item = item.replace(name, value)
    each = f"transform(sequence(0, int({parts}) - 1), p -> {item})"
    return F.expr(f"flatten(transform(filter(array(n, n - 1), m -> m >= {min_chars}), m -> {each}))")


def _only(lines: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose ``at`` is in ``places``, a written table.

    A bit set of hashed places, sized by their count, goes to all tasks and drops most other
    lines before the shuffle of the exact join. Where places outnumber the largest set it
    lets more lines through, which costs shuffle and changes no result."""
    each, least, most = FILTER_BITS
    bits = min(most, max(least, 1 << (each * places.count()).bit_length()))
    place = F.pmod(F.xxhash64("at"), F.lit(bits))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = places.groupBy(word.alias("word")).agg(F.bit_or(one).alias("mask"))
    maybe = lines.withColumn("word", word).join(F.broadcast(words), "word").where(F.call_function("shiftright", "mask", bit).bitwiseAND(F.lit(1)) == 1)
    return maybe.drop("word", "mask").join(places, "at")


def duplicate_lines(docs: DataFrame, min_chars: int = 20, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, line_no, of_doc_id, of_line_no, edits): every line that repeats an earlier one.

    The edit bound is one character: a limit of this operator, as larger bounds would need
    more segments and variants of several deletions.

    Lines come in the order (doc_id, line_no). In normal form, a line repeats an earlier line
    if both are equal, or if both have at least ``min_chars`` characters and one insertion,
    deletion or substitution of a character turns one into the other. ``of_*`` names the
    earliest such line, an equal one first. Whether the earlier line is itself a repeat plays
    no part, so the result doesn't depend on any processing order.

    Equal lines are found by hash. For the rest, all variants within the bound of one edit
    are emitted as hashed keys. A single edit leaves everything before and after it alone, so
    a line is cut into segments and only the segment that holds the edit needs variants: a
    line first offers one key per segment, made of its length, the text before and the text
    after; only where two different lines share such a key are the segment's deletion
    variants emitted and joined. That keeps the work linear in the length of a line. Groups
    of equal keys are reduced to their earliest line by a partial aggregate, so a hot line or
    segment costs one row for each task. Texts are read again for those lines alone, behind a
    bit set of their places. Every link found is checked with ``levenshtein``.

    Null texts have no lines and null doc_ids sort first. Blank lines never repeat anything.
    Rows that share a doc_id but not a text sort by line number, then by a hash of the text;
    full repeats of a row have the same places, so they count as one document."""
    forms = F.xxhash64("s", F.lit(7)).alias("k1"), F.xxhash64(F.reverse("s")).alias("k2"), F.length("s").alias("n")
    ks = F.when(F.col("n") >= min_chars, _segments(segment, min_chars, "{key}")).alias("ks")
    seen = cut(lines_of(docs).select("at", "s", *forms).select("at", "k1", "k2", "n", ks), "lines")
    first = cut(seen.groupBy("k1", "k2", "n").agg(F.min("at").alias("at")), "firsts")
    exact = (
        seen.drop("ks").join(first.withColumnRenamed("at", "of"), ["k1", "k2", "n"]).where("at != of")
        .select("at", "of", F.lit(0).alias("edits"))
    )

    # A segment's key counts if lines of two forms share it; only those lines' texts go on.
    slim = seen.select("k1", F.explode("ks").alias("key"))
    shared = cut(slim.groupBy("key").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x != y").select("key"), "shared")
    kept = slim.join(shared, "key").select("k1").distinct()
    places = cut(first.join(kept, "k1").select("at", "n"), "places")
    text = cut(_only(lines_of(docs), places).select("at", "n", "s"), "texts")
    each = text.select("at", "n", _segments(segment, min_chars, "struct({key} AS key, m AS m, {seg} AS seg)").alias("gs"))
    hit = each.select("at", "n", F.explode_outer("gs").alias("g")).select("at", "n", "g.key", "g.m", "g.seg").join(shared, "key")

    # variants: a segment without one of its characters, and for the shorter line itself
    whole = F.xxhash64("key", F.lit(-1), "seg")
    same = F.expr("transform(sequence(1, length(seg)), i -> xxhash64(key, i, concat(substring(seg, 1, i - 1), substring(seg, i + 1))))")
    less = F.expr("array_distinct(transform(sequence(1, length(seg)), i -> xxhash64(key, -1, concat(substring(seg, 1, i - 1), substring(seg, i + 1)))))")
    equal = F.col("n") == F.col("m")
    variants = hit.where("length(seg) > 0").select(
        "at", equal.alias("short"), F.when(equal, F.concat(same, F.array(whole))).otherwise(less).alias("v"), F.when(equal, F.length("seg")).otherwise(F.lit(-1)).alias("subs")
    ).select("at", "short", "subs", F.posexplode_outer("v").alias("i", "v"))
    empty = hit.where("length(seg) = 0").select("at", equal.alias("short"), F.lit(0).alias("subs"), F.lit(0).alias("i"), whole.alias("v"))
    variants = cut(variants.union(empty).select("at", "v", (F.col("i") < F.col("subs")).alias("sub"), "short"), "variants")
    # sub: lines that share v differ in one place. Else the one short line meets those a character longer.
    met = variants.groupBy("v", "sub").agg(
        F.count(F.lit(1)).alias("c"), F.min("at").alias("low"), F.min(F.when(F.col("short"), F.col("at"))).alias("one"), F.min(F.when(~F.col("short"), F.col("at"))).alias("more")
    ).where("c > 1")
    found = variants.join(met, ["v", "sub"]).select(
        "at", F.when(F.col("sub"), F.col("low")).when(F.col("short"), F.col("more")).otherwise(F.col("one")).alias("of")
    )
    found = cut(found.where("of < at").distinct(), "pairs")
    words = text.select("at", "s")
    checked = (
        found.join(words.withColumnRenamed("s", "sa"), "at").join(words.select(F.col("at").alias("of"), F.col("s").alias("sb")), "of")
        .where(F.levenshtein("sa", "sb", 1) == 1).groupBy("at").agg(F.min("of").alias("of"))
    )
    # a near link of one form holds for all lines of that form, unless an equal line is earlier
    near = first.join(checked.select("at", "of"), "at").select("at", "of", F.lit(1).alias("edits"))
    out = exact.select("at", "of", "edits").union(near)
    back = F.when(F.col("at.d") != NO_ID, F.col("at.d"))
    return out.select(
        back.alias("doc_id"), F.col("at.l").alias("line_no"), F.when(F.col("of.d") != NO_ID, F.col("of.d")).alias("of_doc_id"), F.col("of.l").alias("of_line_no"), "edits", F.col("at.t").alias("text_id")
    )


def drop_duplicate_lines(docs: DataFrame, **how) -> DataFrame:
    """The documents without the lines that repeat an earlier one (see duplicate_lines).

    A document of which only blank lines are left goes, if any of its lines went; others keep
    all their columns, with n_chars set anew where there is such a column. Null and empty
    texts stay as they are. Columns named text_id or gone in the input don't clash."""
    gone = duplicate_lines(docs, **how).groupBy(F.col("doc_id").alias("__d"), F.col("text_id").alias("__t")).agg(F.collect_set("line_no").alias("__gone"))
    # rows travel as one column each, so no column of theirs can clash
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.struct(*docs.columns).alias("row"))
    j = rows.join(gone, F.expr("doc_id <=> __d AND h = __t"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    whole = F.col("__gone").isNull()
    j = j.withColumn("text", F.when(whole, F.col("text")).otherwise(kept)).where(whole | F.col("text").rlike(r"\S"))
    made = {"text": F.col("text"), "n_chars": F.when(whole, F.col("row")["n_chars"]).otherwise(F.length("text").cast("long"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return j.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
