"""The thin contract queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a model may learn from."""
    from .common import held_out

    return _read(spark, sf_dir, "labels").filter(~held_out())


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as Q
    from .common import held_out

    model = Q.fit(_read(spark, sf_dir, "documents"), _labels(spark, sf_dir), "quality")
    scored = Q.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_mincut import extract

    return extract(_read(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity_knn as T
    from .common import held_out

    index = T.fit(_read(spark, sf_dir, "documents"), _labels(spark, sf_dir), "toxic")
    scored = T.score(_read(spark, sf_dir, "documents"), index)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), words=4, percent=85)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated passage and document: every later document with the original it repeats, and the originals."""
    from .common import cut
    from .substring_dedup import shared_passages

    found = cut(shared_passages(_read(spark, sf_dir, "documents")).drop("start_byte", "end_byte"))
    later = found.select("doc_id", F.col("ref_id").alias("partner_id"), "start", "end", F.col("ref_start").alias("partner_start"), F.col("ref_end").alias("partner_end"), "identity", F.lit(False).alias("original"))
    best = F.min(F.struct(F.col("doc_id").alias("partner_id"), F.col("start").alias("partner_start"), F.col("end").alias("partner_end"), "identity")).alias("m")
    first = found.groupBy(F.col("ref_id").alias("doc_id"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end")).agg(best)
    return later.unionByName(first.select("doc_id", "m.partner_id", "start", "end", "m.partner_start", "m.partner_end", "m.identity", F.lit(True).alias("original")))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .aq_ann import search

    return search(_read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid as L
    from .common import held_out

    docs = _read(spark, sf_dir, "documents")
    found = L.identify(docs, L.fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


#: The rules of the contract, as (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge, rule_table

    return judge(_read(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_read(spark, sf_dir, "documents"))


QUERIES = {"op1_quality": op1_quality, "op3_html": op3_html, "op4_toxicity": op4_toxicity, "op7_near_duplicates": op7_near_duplicates, "op9_substring_dedup": op9_substring_dedup, "op8_ann": op8_ann, "op10_langid": op10_langid, "op2_packing": op2_packing, "op5_bpe": op5_bpe, "op6_exact_dedup": op6_exact_dedup, "op11_resampling": op11_resampling, "op12_spelling": op12_spelling, "op13_url_rules": op13_url_rules}

#: CRC-32 of the sixteen half-bytes.
NIBBLES = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, half a byte at a time."""
    digits = f"list_transform(range(1, len(hex(encode({text}))) + 1), lambda i: instr('0123456789ABCDEF', substr(hex(encode({text})), i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END, 1)) - 1)"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, d: xor(c >> 4, ({NIBBLES})[(xor(c, d) & 15) + 1])), 4294967295)"


FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op11_resampling": rf"""
        WITH t AS (SELECT row_number() OVER () AS i, doc_id, true AS own, text FROM documents UNION ALL SELECT row_number() OVER (), item_id, false, text FROM benchmark),
        w AS (SELECT i, own, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t),
        f AS (SELECT i, own, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS f FROM w),
        b AS (SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f)),
        n AS (SELECT i, own, bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
        c AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM n GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ws + 10000) / ((s + 1)::DOUBLE * (wt + 10000)))) AS gain FROM c, (SELECT sum(s)::DOUBLE AS ws, sum(t)::DOUBLE AS wt FROM c)),
        d AS (SELECT i, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM n JOIN g USING (bucket) WHERE own GROUP BY i),
        x AS (SELECT t.i, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM t LEFT JOIN d ON t.i = d.i WHERE own),
        y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
        r AS (SELECT *, CASE WHEN n_features >= 39 THEN row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id, i) END AS r, (SELECT count(*) FROM y WHERE n_features >= 39) AS able FROM y)
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * able // 100 THEN r END AS rank FROM r
    """,
    "op12_spelling": rf"""
        WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({FOLDED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
        hashed AS (SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted),
        edited AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
        words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cuts AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
        pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y USING (rest, i) WHERE x.word <> y.word
            UNION ALL SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word UNION ALL SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word)),
        ordered AS (SELECT a AS word, b, y.n AS nb, x.n AS n, row_number() OVER (PARTITION BY a ORDER BY y.n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM pairs JOIN words x ON x.word = a JOIN words y ON y.word = b),
        forms AS MATERIALIZED (SELECT word, n_near, CASE WHEN nb >= 5 * n THEN b END AS form, CASE WHEN nb >= 5 * n THEN nb END AS form_n FROM ordered WHERE k = 1),
        walk(word, last, steps) AS (SELECT word, word, 0 FROM words UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN forms f ON f.word = walk.last WHERE f.form IS NOT NULL),
        ends AS (SELECT word, arg_max(walk.last, steps) AS root FROM walk GROUP BY word)
        SELECT word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n FROM words LEFT JOIN forms USING (word) JOIN ends USING (word)
    """,
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM t
    """,
    "op13_url_rules": rf"""
        WITH rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, row_number() OVER () AS i, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        c AS (SELECT b.*, h || p AS rule, verdict, row_number() OVER (PARTITION BY i ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS k
              FROM b LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM c WHERE k = 1
    """,
}
