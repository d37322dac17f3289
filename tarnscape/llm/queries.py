"""The registered queries of this subpackage, and SQL that gives the same rows where SQL can."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnscape.llm import ann, clusters, collocations, decontaminate, langid, license_scan, line_dedup, minhash, mixing, pii, simhash, toxicity, warc
from tarnscape.session import table, tidy


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    s = toxicity.scored(docs.select("doc_id", "text"), model)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return s.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


@tidy
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = pages.select("page_id", license_scan.path_of(F.col("url")).alias("path"), F.col("html").alias("text"))
    return license_scan.scan(files, any_file=True)


@tidy
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@tidy
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents")).drop("text_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@tidy
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.queued(table(spark, sf_dir, "documents")).drop("source")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return told.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@tidy
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(e, e.where(F.col("vec_id") % 20 == 0), k=20)


@tidy
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text")


@tidy
def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@tidy
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@tidy
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _clusters_sql(rounds: int = 3) -> str:
    """Rounds one after the other; an integer quotient rounds down for negative sums too."""
    far = "list_sum(list_transform(range(1, 65), lambda i : (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
    assign = "a{r} AS (SELECT n, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.n, c.k, " + far + " AS d FROM v, c{r} AS c) GROUP BY n)"
    mean = """m{r} AS (SELECT k, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM (SELECT a.k, unnest(range(1, 65)) AS i, unnest(v.q) AS x FROM a{p} AS a JOIN v USING (n)) GROUP BY k, i),
        c{r} AS (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{p} AS c LEFT JOIN (SELECT k, list(x::BIGINT ORDER BY i) AS q FROM m{r} GROUP BY k) AS m USING (k))"""
    steps = [assign.format(r=0)] + [x.format(r=r, p=r - 1) for r in range(1, rounds + 1) for x in (mean, assign)]
    return f"""
        WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x : floor(64 * x::DOUBLE)::BIGINT) AS q, sha256('1:' || vec_id) AS h FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INT AS k, q FROM v QUALIFY row_number() OVER (ORDER BY h, q) <= 16),
        {", ".join(steps)},
        s AS (SELECT k, sha256(array_to_string(q, ',')) AS centroid_sha256 FROM c{rounds})
        SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN v USING (n) JOIN s USING (k)"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_warc, op4_line_dedup, op5_decontamination, op6_mixing, op7_language_id, op8_nearest, op9_near_duplicates, op10_pii, op11_clusters, op12_collocations, op13_simhash, pipeline)}

ORACLE = {
    "op11_clusters": _clusters_sql(),
    "op12_collocations": """
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
        p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(s, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM t),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i : w[i : i + k - 1])) AS w FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
        n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
        f AS (SELECT lang, k, w, array_to_string(w, ' ') AS phrase, count(*) AS c FROM g GROUP BY lang, k, w HAVING count(*) >= 30),
        c AS (SELECT lang, phrase, w, k, c AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
        s AS (SELECT c.lang, c.phrase, c.a, cut, x.c AS l, y.c AS r, (2000000 * c.a::HUGEINT) // (x.c::HUGEINT + y.c) AS score
          FROM c JOIN f AS x ON x.lang = c.lang AND x.k = cut AND x.w = c.w[1 : cut] JOIN f AS y ON y.lang = c.lang AND y.k = c.k - cut AND y.w = c.w[cut + 1 :]),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        o AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN (SELECT lang, k, w, c AS over FROM f WHERE k > 2) AS z ON z.lang = b.lang AND contains(' ' || array_to_string(z.w, ' ') || ' ', ' ' || b.phrase || ' ')
          AND array_to_string(z.w, ' ') <> b.phrase AND 100 * z.over::HUGEINT >= 80 * b.a::HUGEINT)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
          SELECT b.*, n.n, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN o USING (lang, phrase) JOIN n USING (lang)) WHERE rank <= 2000""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS low, sha1(h) AS x FROM p),
        c AS (SELECT *, [('0x' || x[1:10])::BIGINT, ('0x' || x[11:20])::BIGINT, ('0x' || x[21:30])::BIGINT, ('0x' || x[31:40])::BIGINT] AS w FROM g)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
          array_to_string(list_transform(range(32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((w[(i // 8)::INT + 1] >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
          CASE WHEN low IS NULL OR page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id IS DISTINCT FROM low AND low IS NOT NULL THEN low END AS refers_to, TRUE AS intact
        FROM c""",
    "op4_line_dedup": """
        WITH l AS (
          SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
        n AS (SELECT doc_id, i::INT AS line_no, trim(lower(line), ' ' || chr(9) || chr(13) || chr(11) || chr(12) || chr(160)) AS s FROM l),
        s AS (SELECT * FROM n WHERE s <> ''),
        f AS (SELECT s, min((doc_id, line_no)) AS place, length(s) AS n FROM s GROUP BY s),
        m AS (SELECT s, place, unnest([n, n - 1]) AS m FROM f WHERE n >= 20),
        h AS (SELECT *, unnest([0, 1]) AS p FROM m WHERE m >= 20),
        k AS (SELECT s, place, m, p, CASE WHEN p = 0 THEN left(s, (m // 2)::INT) ELSE right(s, (m - m // 2)::INT) END AS half FROM h),
        near AS (SELECT a.s, min(b.place) AS old FROM k a JOIN k b ON a.half = b.half AND a.m = b.m AND a.p = b.p AND b.place < a.place AND a.s <> b.s
          WHERE levenshtein(a.s, b.s) <= 1 GROUP BY a.s),
        d AS (SELECT s.doc_id, s.line_no, CASE WHEN f.place < (s.doc_id, s.line_no) THEN f.place ELSE near.old END AS o,
            CASE WHEN f.place < (s.doc_id, s.line_no) THEN 0 ELSE 1 END AS edits
          FROM s JOIN f USING (s) LEFT JOIN near USING (s))
        SELECT doc_id, line_no, o[1] AS of_doc_id, o[2] AS of_line_no, edits FROM d WHERE o IS NOT NULL""",
    "op6_mixing": """
        WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
            md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h, coalesce(md5(text), '') AS t FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source),
        step(i, source, source_size, w, target, done) AS (
          SELECT 0, source, source_size, w, NULL::DOUBLE, FALSE FROM s
          UNION ALL
          SELECT i + 1, source, source_size, w, CASE WHEN full_now THEN 3.0 * source_size ELSE target END, full_now OR NOT more FROM (
            SELECT *, bool_or(full_now AND target IS NULL) OVER () AS more FROM (
              SELECT *, target IS NOT NULL OR lam * w > 3.0 * source_size AS full_now FROM (
                SELECT *, ((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (target IS NOT NULL) OVER (), 0))::DOUBLE
                  / (sum(w) FILTER (target IS NULL) OVER ())::DOUBLE) AS lam FROM step WHERE i = (SELECT max(i) FROM step)))) WHERE more AND i < 10000),
        last AS (SELECT * FROM step WHERE i = (SELECT max(i) FROM step)),
        goal AS (SELECT source, source_size, coalesce(target, w * ((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (target IS NOT NULL) OVER (), 0))::DOUBLE
            / (sum(w) FILTER (target IS NULL) OVER ())::DOUBLE)) AS target FROM last),
        q AS (SELECT doc_id, source, size, t, h, count(*) AS copies, coalesce(sum(size * count(*)) OVER (PARTITION BY source ORDER BY h, doc_id, size, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
          FROM d GROUP BY doc_id, source, size, t, h),
        e AS (SELECT q.*, goal.source_size, goal.target, greatest(1, floor(goal.target / 100))::BIGINT AS most, r * goal.source_size + b AS a, size * copies AS n
          FROM q JOIN goal ON q.source IS NOT DISTINCT FROM goal.source, (SELECT unnest([0, 1, 2])::BIGINT AS r)),
        p AS (SELECT * FROM (SELECT *, a + i * most AS lo, a + least(n, (i + 1) * most) AS hi FROM (
            SELECT *, unnest(range(least(ceil(n / most), ceil((target - a) / most))::BIGINT)) AS i FROM e WHERE n > 0 AND a < target)) WHERE lo < target),
        f AS (SELECT *, greatest(0, least(hi - lo, (SELECT sum(source_size) FROM goal)
            - coalesce(sum(hi - lo) OVER (ORDER BY hi::DOUBLE / target, source IS NULL, source, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS words FROM p),
        g AS (SELECT doc_id, source, size, t, sum(words)::BIGINT AS words FROM f GROUP BY doc_id, source, size, t)
        SELECT q.doc_id, q.size, goal.source_size, goal.target, (coalesce(words, 0) // copies + CASE WHEN k < coalesce(words, 0) % copies THEN 1 ELSE 0 END)::BIGINT AS taken
        FROM (SELECT *, unnest(range(copies)) AS k FROM q) AS q JOIN goal ON q.source IS NOT DISTINCT FROM goal.source
          LEFT JOIN g ON q.doc_id IS NOT DISTINCT FROM g.doc_id AND q.source IS NOT DISTINCT FROM g.source AND q.size = g.size AND q.t = g.t""",
    # links between exact copies are cut to those with the first copy; a set is known by its sorted shingles
    "op9_near_duplicates": """
        WITH RECURSIVE w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') END AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i : i + 4], ' ')))) END AS s FROM w),
        c AS (SELECT s, min(doc_id) AS rep, len(s)::BIGINT AS n FROM s GROUP BY s),
        e AS (SELECT rep, n, md5(unnest(s)) AS k FROM c WHERE n > 0),
        p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.k = b.k AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        l AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p),
        r(d, root) AS (SELECT rep, rep FROM c UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.d WHERE r.root < l.v),
        m AS (SELECT d, min(root) AS component_id FROM r GROUP BY d)
        SELECT s.doc_id, c.n AS n_shingles, CASE WHEN c.n = 0 THEN s.doc_id ELSE m.component_id END AS component_id, c.n = 0 OR m.component_id = s.doc_id AS kept FROM s JOIN c USING (s) JOIN m ON m.d = c.rep""",
}
