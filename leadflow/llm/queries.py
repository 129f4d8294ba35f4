"""One registered query per operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm.common import let, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.pii import BASE, find_pii, listed

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii")

    def of(kinds: tuple[str, ...]):
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of((k,))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(BASE)), 256).alias("base_sha256"), listed(spans).alias("spans"))


# The rules of the query, and the host labels whose hosts make up its block list
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets"]
_URL_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM b
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[.])(ads-track|adult-x|casino-win|cheap-pills|free-bets)([.]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM c"""


@query("op7_url_filter", _URL_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.urlfilter import hosts_with_labels, judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, hosts_with_labels(pages, LISTED_LABELS), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.neardup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2, window=4096)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.decontam import find_passages

    found = find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.col("passages")
    return found.select(
        "doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"), (hit["n_hit"] > 0).alias("contaminated"),
    )


@query("op1_warc")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.warc import read_archives, write_archives

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))
    records = read_archives(write_archives(pages, least_bytes=0))
    page = F.regexp_extract("record_id", "([0-9-]+)$", 1).try_cast("long")  # a null id is written as None
    return records.select(
        page.alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.regexp_extract("refers_to", "([0-9-]+)$", 1).try_cast("long").alias("refers_to"), "payload_ok",
    )


_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, place, list((role, text)) OVER (PARTITION BY conv_id ORDER BY place) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t
), w AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies, min(n_turns) AS n_turns FROM p WHERE place = n_turns GROUP BY prefix
), k AS (
  SELECT conv_id, n_turns, copies FROM w ANTI JOIN (SELECT prefix FROM p WHERE place < n_turns) s USING (prefix)
)
SELECT conv_id, (place - 1) // 256 AS part, any_value(n_turns) AS n_turns, any_value(copies) AS copies,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM t JOIN k USING (conv_id) GROUP BY conv_id, part"""


@query("op2_chat_format", _CHAT_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.conversations import render_chats

    return render_chats(table(spark, sf_dir, "conversations"))


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op3_exact_top_k", _TOPK_SQL)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, factor=256)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.tokens import count_tokens

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(text).cast("long").alias("n_bytes"))
    counts = count_tokens(docs, _tokenizer("piece_bpe_32k.model"), keep=("doc_id", "n_bytes"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.quality import fit, held_out, score_quality

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out()))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _words(text):
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the hash of its id, becomes periodic from a word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("bigint")

    def periodic(ws):
        n = F.size(ws).cast("bigint")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("bigint")
        later = F.transform(F.sequence(a, n - 1), lambda i: F.get(ws, (a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(ws, F.lit(1), a.cast("int")), later), " ")).otherwise("")

    planted = let(_words(F.col("text")), periodic)
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.runs import find_runs

    docs = _with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_runs(docs).select("doc_id", "periodic.*")

    def better(best, r):
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    # runs come by start and period, so an equal one later is not better
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, better)
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


@query("op12_id_files")
def op12_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.idfiles import read_ids, write_ids

    folder = write_ids(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)
    return read_ids(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_LEXICAL_SQL = r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL
), d AS (
  SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM fold WHERE len(ts) > 0
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d
), q AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL
  ) GROUP BY item_id, term
), p AS (
  SELECT doc_id, any_value(n) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM p, s GROUP BY term
), i AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)) AS f FROM p, s
), r AS (
  SELECT item_id, doc_id, CAST(sum(times * w * f) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN i USING (term)
  GROUP BY item_id, doc_id HAVING sum(times * w * f) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r QUALIFY rank <= 20"""


@query("op11_lexical_search", _LEXICAL_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadflow.llm.lexical import build_index, search

    folder = build_index(table(spark, sf_dir, "documents"))
    found, _ = search(spark, folder, table(spark, sf_dir, "benchmark"), k=20)
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
