"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns: others, whatever their names, never reach an operator."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ([3, 1, 2])[((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS lim FROM s),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY lim / w, source NULLS LAST) AS k FROM r),
l AS (SELECT k, lim, w, (1.5::DOUBLE * SUM(source_size) OVER () - COALESCE(SUM(lim) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / SUM(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
v AS (SELECT MIN_BY(level, k) AS level FROM l WHERE lim > w * level),
t AS (SELECT source, source_size, LEAST(lim, w * COALESCE((SELECT level FROM v), 1e308)) AS target FROM r),
f AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
m AS (SELECT doc_id, source, size, md5('mix:' || COALESCE(doc_id::VARCHAR, 'null')) AS h FROM d),
u AS (SELECT m.doc_id, m.size, f.source, f.source_size, f.target, f.rate, FLOOR(f.rate) AS whole, f.rate - FLOOR(f.rate) AS fraction,
      ('0x' || substr(h, 1, 12))::BIGINT AS a, ('0x' || substr(h, 13, 12))::BIGINT AS b FROM m JOIN f ON m.source IS NOT DISTINCT FROM f.source),
g AS (SELECT source, k, ANY_VALUE(target) AS target, ANY_VALUE(whole) AS whole, ANY_VALUE(source_size) AS source_size,
      SUM(CASE WHEN ((a + k * b) % 281474976710656) / 281474976710656.0::DOUBLE < fraction THEN size ELSE 0 END) AS drawn FROM u, range(32) x(k) GROUP BY source, k),
c AS (SELECT source, ARG_MIN(k, ABS(drawn + whole * source_size - target) * 32.0 + k * 1e-9) AS k FROM g GROUP BY source)
SELECT u.doc_id, u.size, u.source_size, u.target,
       (u.size * (u.whole + CASE WHEN ((a + c.k * b) % 281474976710656) / 281474976710656.0::DOUBLE < u.fraction THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source
"""


@query(MIX_SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.media import parse, text_media

    stored = text_media(table(spark, sf_dir, "documents", "doc_id", "text"))
    read = stored.withColumn("p", parse("media"))
    payload = F.col("p.payload")
    feature = F.format_string(
        "mpeg1-l3 frames=%d samples=%d rate=%d crc_bad=%d skipped=%d table=%s/%d",
        F.size("p.offsets"), "p.samples", "p.sample_rate", "p.crc_bad", "p.skipped_bytes", "p.table", "p.table_frames",
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM u),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT k, ARG_MAX(h || r.p, length(h || r.p)) AS rule, ARG_MAX(v, length(h || r.p)) AS verdict
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(p.path, r.p) GROUP BY k)
SELECT page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (k)
"""


@query(URL_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.urlfilter import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), rules)


TOPK_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 64)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query(TOPK_SQL)
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.topk import scaled, top_k

    vectors = scaled(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@query()
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.secrets import scan, summary

    return summary(scan(table(spark, sf_dir, "documents", "doc_id", "text")))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.langid import held_out, predict, train

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    prototypes = train(docs.where(~held_out(F.col("doc_id"))))
    judged = predict(docs.select("doc_id", "text"), prototypes)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: The folder of vocabulary files, unless the session's setting spark.factloom.tokenizers names another, and the model file in it.
TOKENIZERS, PIECES_FILE = "/opt/tokenizers", "piece_bpe_32k.model"
PIECES = f"{TOKENIZERS}/{PIECES_FILE}"


def pieces_path(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.factloom.tokenizers', TOKENIZERS)}/{PIECES_FILE}"


@query()
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.sentencepiece import Codec

    codec = Codec(spark, pieces_path(spark))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = codec.encode(docs).withColumn("back", codec.decode(F.col("ids")))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.length("back").cast("long").alias("n_decoded"), F.sha2("back", 256).alias("decoded_sha256"))


@query()
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.neardup import classes

    return classes(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id")


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.sitetree import extract

    texts = extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query()
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.pii import detect, summary

    return summary(detect(table(spark, sf_dir, "documents", "doc_id", "text")))
