"""Registered queries: sources, profiles, filters, joins, set operations, splits."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textjobs.functions.text import BOM, normalise_label, prefix_key
from textjobs.operators import compare, corpus, prep, profile, split
from textjobs.plans.registry import query, sql_key, sql_strip, sql_tokens, table, texts
from textjobs.sources import files

# ---- sources and sinks --------------------------------------------------


@query("SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    path = files.shared_dir(spark, "csv")
    files.write_csv(docs, path)
    return files.read_csv(spark, path, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")


def _rendered_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat(
        F.lit("intro ###  Name : "), "p_name", F.lit(" ### Brand: "), "p_brand", F.lit(" ### Size: old ### no pair here "),
        F.lit("### Size: "), F.col("p_size").cast("string"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("\n###Type: t: "), "p_type")).otherwise(""),
    ).alias("text"))


@query("""
SELECT p_partkey, p_name AS "Name", p_brand AS "Brand", CAST(p_size AS VARCHAR) AS "Size",
       CASE WHEN p_size > 25 THEN 't: ' || p_type END AS "Type", CAST(NULL AS VARCHAR) AS "Course"
FROM part""")
def kv_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    return files.parse_key_values(
        _rendered_parts(spark, sf), "text", ["Name", "Brand", "Size", "Type", "Course"], ["p_partkey"])


@query("""
SELECT 'Name' AS key, count(*) AS n_parts, count(*) AS n_rows FROM part UNION ALL
SELECT 'Brand', count(*), count(*) FROM part UNION ALL
SELECT 'Size', 2 * count(*), count(*) FROM part UNION ALL
SELECT 'Type', count(*), count(*) FROM part WHERE p_size > 25""")
def kv_key_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return files.key_inventory(_rendered_parts(spark, sf), "text")


@query("""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL
SELECT c_custkey, CAST(NULL AS VARCHAR), c_nationkey, round_even(c_acctbal + 100, 2), c_mktsegment
FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL
SELECT s_suppkey + 1000000000, CAST(NULL AS VARCHAR), s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier""")
def upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    changed = c.where(F.col("c_mktsegment") == "BUILDING").select(
        "c_custkey", "c_nationkey", F.bround(F.col("c_acctbal") + 100, 2).alias("c_acctbal"), "c_mktsegment")
    added = s.select(
        (F.col("s_suppkey") + 1000000000).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"), F.lit("SUPPLIER").alias("c_mktsegment"))
    return compare.upsert(c, changed.unionByName(added), "c_custkey").select(*c.columns)


@query("SELECT doc_id, quality, toxic FROM labels")
def ingest_once(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    path = files.shared_dir(spark, "ingest")
    files.ingest_once(labels, path)
    # the second call finds the target and leaves it alone
    return files.ingest_once(labels.withColumn("quality", F.lit(-1)), path)


@query("""
SELECT conv_id * 1000 + turn AS row_index, role AS model_id, text AS generated_text,
       CAST(NULL AS VARCHAR) AS reference_text, array_to_string(string_split(text, ' '), '|') AS items,
       length(text) / 10000.0 AS rouge_l
FROM conversations""")
def rowresult_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), F.col("role").alias("model_id"),
        F.col("text").alias("generated_text"), F.split("text", " ").alias("gen_ingredients"),
        (F.length("text") / 10000.0).alias("rouge_l"))
    path = files.shared_dir(spark, "rows")
    files.write_json(c, path)
    back = files.read_json(spark, path, files.ROW_RESULT_SCHEMA)
    return back.select("row_index", "model_id", "generated_text", "reference_text",
                       F.array_join("gen_ingredients", "|").alias("items"), "rouge_l")


@query("""
SELECT lang AS model_id, count(*) AS n_samples, round_even(sum(n_chars) / count(*), 4) AS rouge_l_mean,
       CAST(NULL AS DOUBLE) AS bleu_corpus, true AS from_json
FROM documents GROUP BY lang""")
def metrics_sink_scan(spark: SparkSession, sf: str) -> DataFrame:
    per_model = table(spark, sf, "documents").groupBy(F.col("lang").alias("model_id")).agg(
        F.count("*").alias("n_samples"), F.bround(F.sum("n_chars") / F.count("*"), 4).alias("rouge_l_mean"))
    path = files.shared_dir(spark, "metrics")
    files.write_json(per_model, path)
    return files.read_metrics_files(spark, f"{path}/*.json", lines=True).select(
        "model_id", "n_samples", "rouge_l_mean", "bleu_corpus", F.endswith("file_name", F.lit(".json")).alias("from_json"))


@query("""
SELECT lang AS model_id, count(*) AS n_samples, round_even(sum(n_chars) / count(*), 4) AS rouge_l_mean FROM documents GROUP BY lang""")
def metrics_files_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One file per model, each a single object over several lines."""
    per_model = table(spark, sf, "documents").groupBy(F.col("lang").alias("model_id")).agg(
        F.count("*").alias("n_samples"), F.bround(F.sum("n_chars") / F.count("*"), 4).alias("rouge_l_mean"))
    path = files.shared_dir(spark, "metrics")
    pretty = F.to_json(F.struct("model_id", "n_samples", "rouge_l_mean"), {"pretty": "true"})
    per_model.select(F.col("model_id").alias("of"), pretty.alias("value")).write.partitionBy("of").text(path)
    return files.read_metrics_files(spark, f"{path}/*/*.txt").select("model_id", "n_samples", "rouge_l_mean")


# ---- projections, filters, predicates -----------------------------------

@query(f"""
SELECT doc_id, substr({sql_strip("chr(9) || ' ' || text")}, 1, 80) AS strip_cut,
       {sql_strip("substr(chr(9) || ' ' || text, 1, 80)")} AS cut_strip
FROM documents""")
def prefix_key_modes(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("\t "), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", prefix_key(padded).alias("strip_cut"), prefix_key(padded, "cut_strip").alias("cut_strip"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    label = (F.when(F.col("n_chars") < 500, F.concat(F.lit("\xa0"), "lang", F.lit(" " + BOM)))
             .when(F.col("n_chars") < 2000, F.concat("lang", F.lit(BOM + "\n")))
             .when(F.col("source") != "src3", F.col("lang")))
    return table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang", label.alias("label"))


_LABEL_SQL = """CASE WHEN n_chars < 500 THEN lang || ' ' WHEN n_chars < 2000 THEN lang
                WHEN source <> 'src3' THEN lang END"""


@query(f"SELECT doc_id, {_LABEL_SQL} AS label FROM documents", name="normalise_label")
def normalised_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("doc_id", normalise_label("label").alias("label"))


@query(f"SELECT doc_id, label FROM (SELECT doc_id, {_LABEL_SQL} AS label FROM documents) WHERE label IN ('en', 'fr')")
def allowlist_filter(spark: SparkSession, sf: str) -> DataFrame:
    return prep.allowlist_filter(_labelled(spark, sf), "label", ["en", "fr"]).select("doc_id", "label")


@query(f"""
SELECT doc_id, label FROM (SELECT doc_id, {_LABEL_SQL} AS label FROM documents)
WHERE label IN (SELECT CASE WHEN n_regionkey < 3 THEN 'en' ELSE 'de' END FROM nation)""")
def allowlist_table_filter(spark: SparkSession, sf: str) -> DataFrame:
    allowed = table(spark, sf, "nation").select(F.when(F.col("n_regionkey") < 3, "en").otherwise("de").alias("name"))
    return prep.allowlist_table_filter(_labelled(spark, sf), "label", allowed, "name").select("doc_id", "label")


@query("""
WITH x AS (SELECT source AS label, source IN ('src1', 'src2', 'src7') AS ok FROM documents)
SELECT count(*) AS n_before, count(*) FILTER (ok) AS n_after, count(*) FILTER (NOT ok) AS n_dropped,
       round_even(count(*) FILTER (ok) * 100.0 / count(*), 1) AS kept_pct,
       count(DISTINCT label) FILTER (ok) AS labels_kept, count(DISTINCT label) FILTER (NOT ok) AS labels_dropped
FROM x""")
def filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return profile.filter_audit(table(spark, sf, "documents"), "source", ["src1", "src2", "src7"])


@query("SELECT lang, doc_id, CAST(NULL AS VARCHAR) AS \"Diet\", CAST(NULL AS DOUBLE) AS score, source FROM documents")
def reindex_schema(spark: SparkSession, sf: str) -> DataFrame:
    return prep.reindex(table(spark, sf, "documents"), ["lang", "doc_id", "Diet", "score", "source"], {"score": "double"})


@query("""
WITH x AS (SELECT CASE WHEN n_chars < 200 THEN '  ' ELSE source END AS name,
                  CASE WHEN lang <> 'fr' THEN lang END AS items,
                  CASE WHEN contains(text, '###') THEN '' ELSE text END AS body FROM documents),
s AS (SELECT CASE WHEN coalesce(trim(name), '') = '' THEN 0 WHEN coalesce(trim(items), '') = '' THEN 1
             WHEN coalesce(trim(body), '') = '' THEN 2 ELSE 3 END AS step FROM x)
SELECT count(*) AS n_before, count(*) FILTER (step = 0) AS dropped_name, count(*) FILTER (step = 1) AS dropped_items,
       count(*) FILTER (step = 2) AS dropped_body, count(*) FILTER (step = 3) AS n_after FROM s""")
def required_fields_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(
        F.when(F.col("n_chars") < 200, "  ").otherwise(F.col("source")).alias("name"),
        F.when(F.col("lang") != "fr", F.col("lang")).alias("items"),
        F.when(F.contains("text", F.lit("###")), "").otherwise(F.col("text")).alias("body"))
    return profile.required_fields_audit(rows, ["name", "items", "body"])


_PROPS = r'"k": ([0-9]+)'


@query(f"""
WITH x AS (SELECT event_id, regexp_extract(props, '{_PROPS}', 1) || CASE WHEN event_type = 'error' THEN 'x'
           WHEN event_id % 10 = 3 THEN 'd' WHEN event_id % 10 = 4 THEN 'f' WHEN event_id % 10 = 5 THEN 'e1' ELSE '' END AS raw
           FROM events)
SELECT event_id, raw, nullif(try_cast(raw AS DOUBLE), 0) AS amount FROM x""")
def coerce_zero_null(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in text, some with a letter behind them that makes them none."""
    digit = F.col("event_id") % 10
    raw = F.concat(F.regexp_extract("props", _PROPS, 1), F.when(F.col("event_type") == "error", "x").when(
        digit == 3, "d").when(digit == 4, "f").when(digit == 5, "e1").otherwise(""))
    events = table(spark, sf, "events").select("event_id", raw.alias("raw"), raw.alias("amount"))
    return prep.coerce_number(events, "amount")


@query(f"""
SELECT page_id, {sql_strip("chr(160) || url || ' '")} AS url, md5({sql_strip("html || chr(10)")}) AS html_md5 FROM pages""")
def trim_all_strings(spark: SparkSession, sf: str) -> DataFrame:
    padded = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("\xa0"), "url", F.lit(" ")).alias("url"), F.concat("html", F.lit("\n")).alias("html"))
    return profile.strip_strings(padded).select("page_id", "url", F.md5("html").alias("html_md5"))


@query("""
SELECT p_partkey, CASE WHEN p_size = 7 THEN false ELSE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'blue') END AS tagged
FROM part""")
def keyword_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Some labels are missing."""
    parts = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") != 7, F.upper("p_name")).alias("p_name"))
    return profile.keyword_tag(parts, "p_name", ["ring", "blue"]).select("p_partkey", "tagged")


@query("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'badge-diet-vegan' WHEN p_type = 'SMALL' THEN 'badge-diet-nonveg'
       ELSE 'badge-diet-veg' END AS badge FROM part""")
def badge_class(spark: SparkSession, sf: str) -> DataFrame:
    diet = (F.when(F.col("p_type") == "PROMO", "Vegan Diet").when(F.col("p_type") == "SMALL", "Non-Vegetarian")
            .when(F.col("p_type") == "LARGE", "Vegetarian"))
    return table(spark, sf, "part").select("p_partkey", compare.badge(diet).alias("badge"))


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (length(u.text) < 100) AS empty_user,
       count(*) FILTER (a.text IS NULL) AS empty_assistant, count(a.turn) AS with_label
FROM (SELECT * FROM conversations WHERE role = 'user') u
LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1""")
def pair_audit(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    user = c.where(F.col("role") == "user").select(
        "conv_id", "turn", F.when(F.length("text") < 100, " \n").otherwise(F.col("text")).alias("user"))
    answer = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant"), F.col("turn").alias("label"))
    return profile.pair_audit(user.join(answer, ["conv_id", "turn"], "left"), "user", "assistant", "label")


# ---- joins and sets over two sources of documents ------------------------

def _is_a() -> Column:
    return F.col("source") < "src2"


def source_a(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents").where(_is_a())
    return d.select(
        F.col("doc_id").alias("ord"),
        F.when(F.col("n_chars") > 150, F.concat(F.lit(" "), "source", F.lit(" "), F.col("doc_id").cast("string")))
        .otherwise("").alias("TranslatedRecipeName"),
        F.concat("lang", F.lit("\n")).alias("TranslatedIngredients"),
        F.when(F.col("lang") == "en", F.lit("0")).otherwise(F.col("n_chars").cast("string")).alias("TotalTimeInMins"),
        F.col("lang").alias("Cuisine"), F.col("text").alias("TranslatedInstructions"), F.col("source").alias("URL"))


def source_b(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where(~_is_a()).join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("ord"), F.col("lang").alias("TranslatedIngredients"),
        F.col("text").alias("TranslatedInstructions"), F.col("n_chars").cast("string").alias("TotalTimeInMins"),
        F.lit("10").alias("PrepTimeInMins"), F.lit("20").alias("CookTimeInMins"),
        F.col("toxic").cast("string").alias("Servings"), F.col("lang").alias("Cuisine"), F.col("source").alias("Course"),
        F.col("quality").cast("string").alias("Diet"))


_SOURCES = f"""
a AS (SELECT doc_id AS ord, CASE WHEN n_chars > 150 THEN ' ' || source || ' ' || doc_id ELSE '' END AS name,
             lang || chr(10) AS items, CASE WHEN lang = 'en' THEN '0' ELSE CAST(n_chars AS VARCHAR) END AS mins,
             lang, text, {sql_key("text")} AS k FROM documents WHERE source < 'src2'),
b AS (SELECT d.doc_id AS ord, d.lang, d.text, CAST(quality AS VARCHAR) AS diet, d.source AS course,
             CAST(toxic AS VARCHAR) AS servings, {sql_key("d.text")} AS k
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.source >= 'src2'),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS rn FROM b) WHERE rn = 1)
"""


@query(f"WITH {_SOURCES} SELECT a.ord, b1.diet, b1.course, b1.servings FROM a LEFT JOIN b1 ON a.k IS NOT DISTINCT FROM b1.k")
def enrich_left_join(spark: SparkSession, sf: str) -> DataFrame:
    a = source_a(spark, sf).withColumn("k", prefix_key("TranslatedInstructions"))
    b = source_b(spark, sf).withColumn("k", prefix_key("TranslatedInstructions"))
    joined = prep.enrich_left_join(a.select("ord", "k"), b, "k", "ord", ["Diet", "Course", "Servings"])
    return joined.select("ord", F.col("Diet").alias("diet"), F.col("Course").alias("course"),
                         F.col("Servings").alias("servings"))


@query(f"WITH {_SOURCES} SELECT ord, lang FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k IS NOT DISTINCT FROM b.k)")
def anti_join_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    a = source_a(spark, sf).select(prefix_key("TranslatedInstructions").alias("k"))
    b = source_b(spark, sf).select("ord", F.col("Cuisine").alias("lang"), prefix_key("TranslatedInstructions").alias("k"))
    return prep.anti_join_rows(b, a, "k").select("ord", "lang")


@query(f"""
WITH {_SOURCES}, j AS (SELECT b1.diet FROM a LEFT JOIN b1 ON a.k IS NOT DISTINCT FROM b1.k)
SELECT count(*) AS n_rows, count(diet) AS n_enriched, count(*) - count(diet) AS n_unmatched,
       (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS n_only_b FROM j""")
def join_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = source_a(spark, sf).withColumn("k", prefix_key("TranslatedInstructions"))
    b = source_b(spark, sf).withColumn("k", prefix_key("TranslatedInstructions"))
    return prep.join_audit(a, b, "k", "ord", "Diet")


@query(f'SELECT {sql_key("text")} AS key, min(doc_id) AS ord FROM documents GROUP BY 1')
def keep_first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), prefix_key("text").alias("key"))
    return prep.first_per_key(rows, "key", "ord", ["ord"])


@query(f"""
WITH {_SOURCES}, n AS (
  SELECT name, items, mins, servings, a.lang AS cuisine, course, diet, a.text AS text
  FROM a LEFT JOIN b1 ON a.k IS NOT DISTINCT FROM b1.k WHERE {sql_strip("name")} <> ''),
u AS (SELECT DISTINCT * FROM n)
SELECT {sql_strip("name")} AS name, {sql_strip("items")} AS items, nullif(try_cast(mins AS DOUBLE), 0) AS mins,
       servings, cuisine, course, diet, md5({sql_strip("text")}) AS body
FROM u WHERE {sql_strip("items")} <> '' AND {sql_strip("text")} <> ''""")
def clean_corpus(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = prep.merge_and_clean(source_a(spark, sf), source_b(spark, sf))
    names = ["name", "items", "mins", "servings", "cuisine", "course", "diet", "text"]
    return cleaned.toDF(*names).withColumn("body", F.md5("text")).drop("text")


@query(f"""
WITH {_SOURCES}
SELECT 'a' AS origin, ord, lang, name, CAST(NULL AS VARCHAR) AS diet FROM a UNION ALL
SELECT 'b', ord, lang, CAST(NULL AS VARCHAR), diet FROM b""")
def union_aligned(spark: SparkSession, sf: str) -> DataFrame:
    a = source_a(spark, sf).select(F.lit("a").alias("origin"), "ord", F.col("Cuisine").alias("lang"),
                                   F.col("TranslatedRecipeName").alias("name"))
    b = source_b(spark, sf).select(F.col("Diet").alias("diet"), F.col("Cuisine").alias("lang"), "ord",
                                   F.lit("b").alias("origin"))
    return a.unionByName(b, allowMissingColumns=True)


_DEDUP_TEXT = "CASE WHEN source < 'src14' THEN text ELSE text || ' ' END"


@query(f"""
SELECT lang, md5({sql_strip("t")}) AS body FROM (SELECT DISTINCT lang, {_DEDUP_TEXT} AS t FROM documents)""")
def dedup_then_trim(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.when(F.col("source") < "src14", F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    rows = table(spark, sf, "documents").select("lang", padded.alias("text")).dropDuplicates()
    return profile.strip_strings(rows).select("lang", F.md5("text").alias("body"))


_KEYS_SQL = f"""
a AS (SELECT DISTINCT {{a}} AS k FROM {{left}}),
b AS (SELECT DISTINCT {{b}} AS k FROM {{right}})"""
_OVERLAP_SQL = f"""
SELECT '{{name}}' AS pair, (SELECT count(*) FROM a) AS keys_a, (SELECT count(*) FROM b) AS keys_b,
       (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS "both",
       (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a,
       (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_b,
       (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS keys_all"""
_CUT_STRIP = sql_strip("substr(text, 1, 80)")


def _overlap_sql(name: str, left: str, right: str) -> str:
    keys = _KEYS_SQL.format(a=_CUT_STRIP, b=_CUT_STRIP, left=left, right=right)
    return f"SELECT * FROM (WITH {keys} {_OVERLAP_SQL.format(name=name)})"


@query(_overlap_sql("sources", "documents WHERE source < 'src2'", "documents WHERE source >= 'src2'") + " UNION ALL "
       + _overlap_sql("benchmark", "documents", "benchmark"))
def key_overlap(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("k", prefix_key("text", "cut_strip"))
    bench = table(spark, sf, "benchmark").withColumn("k", prefix_key("text", "cut_strip"))
    pairs = [("sources", d.where(_is_a()), d.where(~_is_a())), ("benchmark", d, bench)]
    first, second = (prep.key_overlap(left, right, "k").withColumn("pair", F.lit(name)) for name, left, right in pairs)
    return first.unionByName(second)


@query(f"""
WITH {_KEYS_SQL.format(a=sql_key("text"), b=sql_key("text"), left="documents WHERE source < 'src2'", right="documents WHERE source >= 'src2'")}
SELECT k AS key, 'both' AS part FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL
SELECT k, 'only_a' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL
SELECT k, 'only_b' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def key_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("k", prefix_key("text"))
    return prep.key_sets(d.where(_is_a()), d.where(~_is_a()), "k")


# ---- profiles -----------------------------------------------------------

def _null_sql(columns: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, {len(columns)} AS n_columns, count(*) - count({c}) AS n_null, "
        f"count({c}) AS n_filled, round_even((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, "
        f"round_even(count({c}) * 100.0 / count(*), 1) AS coverage_pct FROM x" for c in columns)
    return f"WITH x AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) {rows}"


@query(_null_sql(["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]))
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.null_profile(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left"))


@query("""
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang, n_chars FROM documents)) AS n_distinct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, n_chars FROM documents)) AS n_duplicates
FROM documents""")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.duplicate_rows(table(spark, sf, "documents").select("text", "lang", "n_chars"))


@query("""
SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 15""")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(table(spark, sf, "documents"), "source", top=15)


@query(f'SELECT {sql_key("text")} AS value, count(*) AS n FROM documents GROUP BY 1')
def value_counts_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of a column of texts, without a cut."""
    return profile.value_counts(table(spark, sf, "documents").select(prefix_key("text").alias("key")), "key")


@query("""
SELECT quality AS value, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY quality""")
def value_counts_with_null(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return profile.value_counts(joined, "quality", keep_null=True)


@query(f"""
WITH x AS (SELECT lang, len({sql_tokens("text")}) AS w FROM documents)
SELECT lang, count(*) AS n_texts, min(w) AS min_words, round_even(avg(w), 4) AS mean_words, max(w) AS max_words,
       round_even(quantile_cont(w, 0.5), 4) AS median_words, round_even(quantile_cont(w, 0.95), 4) AS p95_words
FROM x GROUP BY lang""")
def length_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.length_profile(texts(spark, sf, "documents"), "text", ["lang"])


@query("""
SELECT o_orderpriority, count(*) AS n_values, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value,
       round_even(avg(o_totalprice), 2) AS mean_value, count(*) FILTER (o_totalprice = 0) AS n_zero,
       round_even(quantile_cont(o_totalprice, 0.5), 4) AS median_value
FROM orders GROUP BY o_orderpriority""")
def numeric_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.numeric_profile(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])


@query(f"""
WITH x AS (SELECT role, len({sql_tokens("text")}) AS w FROM conversations)
SELECT role, count(*) AS n_texts, round_even(avg(CASE WHEN w <= 32 THEN 1.0 ELSE 0 END), 4) AS within_32,
       round_even(avg(CASE WHEN w <= 128 THEN 1.0 ELSE 0 END), 4) AS within_128,
       round_even(avg(CASE WHEN w <= 1024 THEN 1.0 ELSE 0 END), 4) AS within_1024
FROM x GROUP BY role""")
def length_budget(spark: SparkSession, sf: str) -> DataFrame:
    return profile.length_budget(table(spark, sf, "conversations"), "text", [32, 128, 1024], ["role"])


@query("SELECT doc_id, substr(text, 1, 200) AS text, lang FROM documents ORDER BY doc_id LIMIT 1")
def head_sample(spark: SparkSession, sf: str) -> DataFrame:
    return profile.head_sample(table(spark, sf, "documents"), "doc_id", {"text": 200, "lang": None})


# ---- splits -------------------------------------------------------------

_SPLIT_SQL = """
s AS (SELECT doc_id, text, CASE WHEN r <= 60 THEN 'test' WHEN r <= 90 THEN 'val' ELSE 'train' END AS split FROM (
  SELECT doc_id, text, row_number() OVER (ORDER BY md5('42-' || doc_id), CAST(doc_id AS VARCHAR)) AS r FROM documents))"""


def _split(spark: SparkSession, sf: str) -> DataFrame:
    return split.holdout_split(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 60, 30)


@query(f"WITH {_SPLIT_SQL} SELECT doc_id, split FROM s")
def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("doc_id", "split")


@query(f"""
WITH {_SPLIT_SQL} SELECT split, count(*) AS n_rows,
       round_even(count(*) * 100.0 / (SELECT count(*) FROM s), 1) AS pct FROM s GROUP BY split""")
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_sizes(_split(spark, sf))


def _leak_sql(name: str, key: str) -> str:
    def both(x: str, y: str) -> str:
        return f"count(*) FILTER (list_contains(p, '{x}') AND list_contains(p, '{y}')) AS {x}_{y}"
    return (f"SELECT '{name}' AS key_kind, count(*) AS n_keys, {both('train', 'val')}, {both('train', 'test')}, "
            f"{both('val', 'test')} FROM (SELECT {key} AS k, list(DISTINCT split) AS p FROM s GROUP BY {key})")


@query(f"WITH {_SPLIT_SQL} {_leak_sql('id', 'doc_id')} UNION ALL {_leak_sql('prefix', sql_key('text'))}")
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _split(spark, sf)
    by_id = split.split_leakage(rows, F.col("doc_id")).withColumn("key_kind", F.lit("id"))
    return by_id.unionByName(split.split_leakage(rows, prefix_key("text")).withColumn("key_kind", F.lit("prefix")))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey >= (SELECT min(k) FROM (SELECT o_orderkey AS k FROM orders ORDER BY k DESC LIMIT 100))
       THEN 'test' ELSE 'train' END AS split FROM orders""")
def tail_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return split.tail_holdout(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100)



@query("""
SELECT conv_id, turn, CASE WHEN r <= 31 THEN 'test' WHEN r <= 48 THEN 'val' ELSE 'train' END AS split FROM (
  SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42-' || conv_id || '-' || turn), conv_id || '-' || turn) AS r FROM conversations)""")
def holdout_split_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """A split of turns whose key, the conversation, repeats."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    return split.holdout_split(turns, "conv_id", 31, 17, ties=("turn",))


@query("""
SELECT conv_id, turn, CASE WHEN row_number() OVER (ORDER BY conv_id DESC, turn DESC) <= 10 THEN 'test' ELSE 'train' END AS split
FROM conversations""")
def tail_holdout_repeated(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    return split.tail_holdout(turns, "conv_id", 10, ties=("turn",))


# ---- the whole preparation ----------------------------------------------

_CUISINE = "CASE {x} WHEN 'en' THEN 'Indian' WHEN 'fr' THEN 'Bengali Recipes' WHEN 'de' THEN 'Oriya Recipes' END"


@query(f"""
WITH {_SOURCES}, fb AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS rn FROM b WHERE lang <> 'es') WHERE rn = 1),
n AS (
  SELECT name, items, mins, servings, {_CUISINE.format(x="a.lang")} AS cuisine, course, diet, a.text AS text
  FROM a LEFT JOIN fb ON a.k IS NOT DISTINCT FROM fb.k WHERE a.lang <> 'es' AND {sql_strip("name")} <> ''),
u AS (SELECT DISTINCT * FROM n),
c AS (SELECT {sql_strip("name")} AS name, {sql_strip("items")} AS items, cuisine, course, diet, {sql_strip("text")} AS text
      FROM u WHERE {sql_strip("items")} <> '' AND {sql_strip("text")} <> ''),
p AS (SELECT *, 'Generate a' || CASE WHEN lower(substr(d, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'n ' ELSE ' ' END || d
             || CASE WHEN course IS NULL THEN '' ELSE ' ' || lower(course) END || ' recipe for ' || name AS user_message,
             '**' || name || '**' || repeat(chr(10), 3) || '**Ingredients:**' || chr(10) || items || chr(10) || chr(10)
             || '**Instructions:**' || chr(10) || text AS answer
      FROM (SELECT *, concat_ws(' ', diet, cuisine) AS d FROM c)),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || name || '-' || user_message || '-' || answer)) AS i FROM p)
SELECT name, user_message, md5(answer) AS answer_md5, cuisine, diet, course, cuisine <> 'Oriya Recipes' AS tagged,
       CASE WHEN i <= 20 THEN 'test' WHEN i <= 30 THEN 'val' ELSE 'train' END AS split FROM r""")
def prepare_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """From both halves of the documents to split folders and back."""
    named = F.when(F.col("Cuisine") == "en", F.lit(BOM + "Indian ")).when(F.col("Cuisine") == "fr", "Bengali Recipes").when(
        F.col("Cuisine") == "de", "\xa0Oriya Recipes").otherwise("Elsewhere")
    a, b = (df.withColumn("Cuisine", named) for df in (source_a(spark, sf), source_b(spark, sf)))
    stored = corpus.prepare_corpus(a, b, files.shared_dir(spark, "splits"), 20, 10)
    return stored.select("name", "user_message", F.md5("assistant_response").alias("answer_md5"), "cuisine", "diet", "course", "tagged", "split")
