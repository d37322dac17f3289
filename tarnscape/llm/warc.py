"""WARC archives: written by Spark's text sink, read back by boundary chains. DataFrame functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnscape.session import cut, drop, new_path

MAGIC = "WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits at a time, of which conv() makes 8 digits."""
    h = F.sha1(payload)
    part = lambda i: F.lpad(F.translate(F.conv(F.substring(h, i, 10), 16, 32), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32), 8, "A")
    return F.concat(*[part(i) for i in (1, 11, 21, 31)])


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, head, body): one WARC record per row.

    Of equal payloads of at least ``least`` bytes, the row with the smallest page_id becomes a
    response and the others revisits of it; shorter ones are all responses. Rows that repeat
    the smallest page_id with one payload are all responses. A null html is an empty payload,
    a null page_id sorts last, and a null url gives no target."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    # Only digests that repeat matter. Their table is written first, so Spark knows its size:
    # it broadcasts a small one, and payloads then don't move; a large one joins by a shuffle.
    first = p.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    p = p.join(cut(first.drop("n"), "repeated"), "digest", "left")
    again = (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit("\r\n"))
    target = F.regexp_replace("url", r"[\r\n]", "")
    none = F.lit("")
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("page_id"))),
        F.when(target.isNull(), none).otherwise(line("WARC-Target-URI", target)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(again, F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit(REVISIT)))).otherwise(none),
        line("X-Payload-Length", F.col("size").cast("string")), line("Content-Length", F.when(again, "0").otherwise(F.col("size").cast("string"))), F.lit("\r\n"),
    )
    return p.select("page_id", head.alias("head"), F.when(again, none).otherwise(F.col("html")).alias("body"))


def write_archives(pages: DataFrame, path: str, least: int = 0, rows_per_file: int = 50_000) -> None:
    """Archives of at most ``rows_per_file`` records in the folder ``path``, on any store that Spark writes.

    A record ends with two line ends; the sink adds the last byte. Spark commits files as a
    whole, so a lost executor leaves none half written."""
    rows = records(pages, least).select(F.concat("head", "body", F.lit("\r\n\r")).alias("value"))
    rows.write.option("lineSep", "\n").option("maxRecordsPerFile", rows_per_file).text(path)


def _pieces(spark, path: str) -> DataFrame:
    """What stands between two magics, with the file and its place in the order of a split."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("seq"), "value"
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds at: the byte at which each piece begins. Splits' lengths add up to where the next one begins.

    The windows run over one split (a block of a file) and over one file's splits."""
    p = pieces.withColumn("len", F.octet_length("value") + len(MAGIC)).drop("value")
    own = Window.partitionBy("file", "split").orderBy("seq")
    splits = p.groupBy("file", "split").agg(F.sum("len").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", before.alias("base"))
    p = p.withColumn("in", F.sum("len").over(own) - F.col("len"))
    return p.join(splits, ["file", "split"]).withColumn("at", F.col("base") + F.col("in")).drop("in", "base")


def _header(value: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), F.substring_index(value, "\r\n\r\n", 1), F.lit("\r\n")), rf"\r\n{key}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _reached(nodes: DataFrame) -> DataFrame:
    """(file, run, enter): the runs of candidates that can be reached from a file's start, and where.

    A run ends where its last candidate points; a pointer may enter a run anywhere. Pointers
    only lead forward and jump twice as far in each round, so the rounds are at most the
    logarithm of the number of runs; more would mean a cycle, and raise."""
    ends = nodes.where(~F.col("follow")).select("file", "run", F.col("next").alias("to"))
    entry = nodes.select("file", F.col("start").alias("to"), F.col("run").alias("run2"))
    hop = cut(ends.join(entry, ["file", "to"]).select("file", "run", "run2", F.col("to").alias("enter")), "hop")
    reach = cut(nodes.where("start = 0").select("file", "run", F.col("start").alias("enter")), "reach")
    rounds, most = 0, hop.count().bit_length() + 1
    while not hop.isEmpty():
        rounds += 1
        if rounds > most:
            raise RuntimeError("the chain of records has a cycle")
        fresh = reach.join(hop, ["file", "run"]).select("file", F.col("run2").alias("run"), hop["enter"])
        grown = cut(reach.union(fresh).groupBy("file", "run").agg(F.min("enter").alias("enter")), "reach")
        far = hop.select("file", F.col("run").alias("run2"), F.col("run2").alias("run3"), F.col("enter").alias("enter3"))
        onward = cut(hop.join(far, ["file", "run2"]).select("file", "run", F.col("run3").alias("run2"), F.col("enter3").alias("enter")), "hop")
        drop(reach)
        drop(hop)
        reach, hop = grown, onward
    return reach


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of every record.

    Tasks split the files at every magic, inside payloads too. Each candidate record points
    to its successor: its own start, its header and its content length further on. Only what
    can be reached from the start of a file is a record. First, runs of candidates that
    point to the very next candidate shrink to one node; then pointers jump from the file's
    start, twice as far in each round. Digests are taken where a piece is read; payloads that
    hold a magic are put together again from their pieces. ``intact`` says whether the
    payload read has the length and digest of its header."""
    pieces = _pieces(spark, path)
    v = F.col("value")
    head = F.octet_length(F.substring_index("value", "\r\n\r\n", 1)) + 4
    body = F.expr("substr(value, length(substring_index(value, '\\r\\n\\r\\n', 1)) + 5)")
    payload = F.expr("left(b, length(b) - 4)")
    told = pieces.withColumn("b", body).select(
        "file", "split", "file_size", "seq", "value", head.alias("head"), _header(v, "Content-Length").try_cast("long").alias("content"), _header(v, "WARC-Type").alias("record_type"),
        _header(v, "WARC-Record-ID").alias("id"), _header(v, "WARC-Refers-To").alias("ref"), F.substring_index(_header(v, "WARC-Payload-Digest"), "sha1:", -1).alias("told"),
        _header(v, "X-Payload-Length").try_cast("long").alias("full"), base32_sha1(payload.cast("binary")).alias("made"),
    )
    all_ = cut(_placed(told), "candidates")
    # where a record begins: at its magic; a file's first piece lies before its first magic
    start = F.col("at") - len(MAGIC)
    # a length in a payload may be anything: below 0 or beyond the file, it makes no candidate
    fits = F.when((F.col("content") >= 0) & (F.col("content") <= F.col("file_size")), start + len(MAGIC) + F.col("head") + F.col("content") + 4)
    cand = all_.where("at > 0").withColumn("start", start).withColumn("next", fits).where("next > start AND next <= file_size")
    nodes = cand.select("file", "file_size", "start", "next")
    order = Window.partitionBy("file").orderBy("start")
    nodes = nodes.withColumn("follow", F.coalesce(F.lead("start").over(order), F.col("file_size")) == F.col("next"))
    breaks = F.coalesce(F.sum((~F.col("follow")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nodes = cut(nodes.withColumn("run", breaks), "nodes")
    real = nodes.join(_reached(nodes), ["file", "run"]).where("start >= enter").select("file", "start", F.col("next").alias("stop"))
    rec = cand.join(real, ["file", "start"])
    several = F.col("len") + F.col("start") < F.col("next")  # a magic inside: more pieces follow
    shown = ["file", "id", "record_type", "ref", "told", "full", "content", "made"]
    whole = rec.where(~several | (F.col("content") == 0)).select(*shown)
    parts = cut(rec.where(several & (F.col("content") > 0)).select("file", "at", "start", "stop", *shown[1:7]), "parts")
    if not parts.isEmpty():
        # a piece belongs to the last record that began before it in its file, if that one isn't over
        marks = parts.select("file", "at", "start", "stop")
        inside = all_.select("file", "split", "seq", "at").join(marks, ["file", "at"], "left")
        inside = inside.select("file", "split", "seq", "at", F.when(F.col("start").isNotNull(), F.struct("start", "stop")).alias("own"))
        inside = inside.withColumn("r", F.last("own", ignorenulls=True).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        inside = cut(inside.where(F.col("at") < F.col("r.stop")).select("file", "split", "seq", "at", "r.start"), "inside")
        # splits are numbered alike in each scan of the files, so places can be joined to values
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC)
        again = pieces.select("file", "split", "seq", "value").join(inside, ["file", "split", "seq"]).groupBy("file", "start").agg(text.alias("value")).withColumn("b", body)
        again = again.select("file", "start", base32_sha1(F.expr("left(b, length(b) - 4)").cast("binary")).alias("made"))
        whole = whole.union(parts.join(again, ["file", "start"]).select(*shown))
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    fresh = F.col("record_type") == "response"
    return whole.select(
        number("id").alias("page_id"), F.when(fresh, F.col("content")).otherwise(F.col("full")).alias("payload_bytes"), F.when(fresh, F.col("made")).otherwise(F.col("told")).alias("payload_digest"),
        "record_type", number("ref").alias("refers_to"), F.when(fresh, (F.col("made") == F.col("told")) & (F.col("content") == F.col("full"))).otherwise(F.lit(True)).alias("intact"),
    )


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back (see read_archives)."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
