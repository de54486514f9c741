"""The registered queries of this package and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textjobs.llm import decontam, langid, periods, private, ranked, secrets, toolcalls, topk, warc
from textjobs.llm.nearjoin import near_join
from textjobs.llm.packing import pack_documents
from textjobs.llm.substrings import remove_repeats
from textjobs.llm.tokens import id_digests, token_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WORD_BPE, WORD_BPE_IDS = "word_bpe_49k.json", 49_408
BYTE_BPE = "byte_bpe_50k.json"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_text(spans) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def spans_of(kinds: list[str], then: Callable[[Column], Column]) -> Column:
    return then(F.filter("spans", lambda s: s["kind"].isin(kinds)))


@query()
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in whole documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs).drop("text")
    base = spans_of([r.kind for r in secrets.BASE_RULES], spans_text)
    return found.select(
        "doc_id",
        *[spans_of([k], F.size).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )


@query()
def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as packed ids in files, read back."""
    docs = table(spark, sf_dir, "documents")
    target = token_file(docs, public_tokenizers.path(WORD_BPE), WORD_BPE_IDS, end_id=1, drop_space=True, special_tokens=True)
    return id_digests(spark, target)


SQL_WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS owner FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> owner THEN owner END AS refers_to,
  true AS verified
FROM o
"""


@query(SQL_WARC)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to an archive and read back."""
    target = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(spark, target).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


@query()
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words in whole documents."""
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    found = decontam.search(index, table(spark, sf_dir, "benchmark"), window=10)
    items = F.transform("items", lambda i: i.cast("string"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL_TOOL_CALLS = """
WITH c AS (
  SELECT conv_id, turn, role, text, 'c' || conv_id || '-' || turn AS call_id FROM conversations WHERE role <> 'assistant'),
r AS (SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, text, turn FROM conversations WHERE role = 'assistant'),
f AS (
  SELECT conv_id, call_id, count(*) AS n_results, arg_min(text, (turn, text)) AS result FROM r GROUP BY conv_id, call_id),
k AS (SELECT conv_id, call_id, count(*) AS same FROM c GROUP BY conv_id, call_id),
j AS (
  SELECT c.*, coalesce(f.n_results, 0) AS n_results, f.result, k.same,
    c.turn >= 2 AND d.call_id IS NULL AS missing,
    row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS position
  FROM c LEFT JOIN f USING (conv_id, call_id) LEFT JOIN k USING (conv_id, call_id)
  LEFT JOIN k d ON d.conv_id = c.conv_id AND d.call_id = 'c' || c.conv_id || '-' || (c.turn - 2)),
e AS (
  SELECT *, concat_ws('; ', CASE WHEN same > 1 THEN 'repeated identifier' END, CASE WHEN missing THEN 'missing dependency' END,
    CASE WHEN n_results = 0 THEN 'no result' END, CASE WHEN role = 'system' THEN '$.role: not in enum' END) AS error FROM j)
SELECT conv_id, call_id, CAST(position AS BIGINT) AS position, error = '' AS valid, nullif(error, '') AS error,
  CAST(n_results AS BIGINT) AS n_results,
  '{"arguments":{"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(call_id)
    || ',"name":"reply","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS canonical
FROM e
"""

REPLY_SCHEMA = {
    "type": "object", "required": ["role", "text", "turn"], "additionalProperties": False,
    "properties": {
        "role": {"type": "string", "enum": ["user"]}, "text": {"type": "string", "minLength": 1},
        "turn": {"type": "integer", "minimum": 0},
    },
}


@query(SQL_TOOL_CALLS)
def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as calls: every turn that is not the assistant's asks for a reply
    and depends on the call two turns before; the assistant's next turn is its
    result.  Only the user may ask.  A reply to no call is a row of its own;
    the SQL has calls only, and the given tables hold no such reply."""
    turns = table(spark, sf_dir, "conversations")

    def call_id(turn: Column) -> Column:
        return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    turn = F.col("turn")
    calls = turns.filter(~F.col("role").eqNullSafe("assistant")).select(
        "conv_id", turn.alias("seq"), call_id(turn).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("role", "text", "turn")).alias("arguments"),
        F.when(turn >= 2, F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = turns.filter(F.col("role") == "assistant").select(
        "conv_id", call_id(turn - 1).alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    return toolcalls.link_calls(calls, results, {"reply": REPLY_SCHEMA}, every_result=True)


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents packed into sequences of 1024 ids."""
    return pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0, size=1024, special_tokens=True)


@query()
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of whole documents in strings of 400 bytes that repeat."""
    return remove_repeats(table(spark, sf_dir, "documents"), length=400)


SQL_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


@query(SQL_TOP_K)
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every 50th vector, against all rows."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, factor=256)


@query()
def op9_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents on five-word shingles, similarity 0.8."""
    return near_join(table(spark, sf_dir, "documents"), threshold=0.8)


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, F.col("doc_id").isNotNull() & ~langid.held_out())
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query()
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in whole documents; the counts are of base spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = private.find_private(docs, private.fit(docs)).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in private.KINDS],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents whose checksum of the doc_id ends in 0 repeat a stretch of
    their words from some word on; the others, null texts and null ids stay."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(number / 10).cast("long")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("_words").cast("long")
    rows = docs.select("doc_id", "text", g.alias("_g"), F.when(number % 10 == 0, words).alias("_words"))
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(
        "_words", (F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")) + 1).cast("int")))
    text = F.when(F.size("_words") > 0, F.array_join(moved, " ")).otherwise(F.col("text"))
    return rows.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p)).select("doc_id", text.alias("text"))


@query()
def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four or more periods of words in whole documents."""
    found = periods.find_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"], r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


SQL_RANKED = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id),
places AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM places WHERE place <= 10
"""


@query(SQL_RANKED)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    index = ranked.build_index(table(spark, sf_dir, "documents"))
    return ranked.search(index, table(spark, sf_dir, "benchmark"), k=10)
