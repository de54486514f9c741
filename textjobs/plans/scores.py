"""Registered queries: row scores, corpus scores, intervals, scorecards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textjobs.functions.hashing import PRIME
from textjobs.operators import parse, score
from textjobs.plans.inputs import (
    CONV_EVAL_SQL, conv_eval, doc_eval, sql_normalised, sql_parse, sql_words, words,
)
from textjobs.plans.registry import query, sql_tokens, table, texts
from textjobs.plans.text import LINE_ITEMS_SQL, _turns, _TURNS_SQL, line_items
from textjobs.sources.files import save_and_reread

# ---- SQL pieces ---------------------------------------------------------


def _ratio(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0), 0.0)"


def _f1(p: str, r: str) -> str:
    return f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0)"


def sql_prf(src: str, both: str, g: str, r: str, prefix: str) -> str:
    p, q = _ratio(both, g), _ratio(both, r)
    return (f"round_even({p}, 4) AS {prefix}precision, round_even({q}, 4) AS {prefix}recall, "
            f"round_even({_f1(p, q)}, 4) AS {prefix}f1")


def _rouge_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


def sql_rouge(p: str, source: str, key: str, g: str, r: str) -> str:
    """CTE ``<p>_rouge(key, rouge_l)``: the table of the longest common
    subsequence, row by row for all pairs at once."""
    return f"""
{p}_rt AS (SELECT {key} AS key, {_rouge_tokens(f"coalesce({g}, '')")} AS a, {_rouge_tokens(f"coalesce({r}, '')")} AS b FROM {source}),
{p}_dp AS (SELECT key, 0 AS i, list_transform(b, lambda t: 0) AS d FROM {p}_rt WHERE len(a) > 0 AND len(b) > 0
  UNION ALL
  SELECT key, i, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
    SELECT x.key, x.i + 1 AS i, list_transform(x.d, lambda v, j: greatest(v, CASE WHEN y.b[j] = y.a[x.i + 1]
           THEN 1 + CASE WHEN j > 1 THEN x.d[j - 1] ELSE 0 END ELSE 0 END)) AS c
    FROM {p}_dp x JOIN {p}_rt y ON y.key = x.key WHERE x.i < len(y.a))),
{p}_lcs AS (SELECT y.key, len(a) AS na, len(b) AS nb, coalesce(x.d[len(b)], 0) AS lcs
            FROM {p}_rt y LEFT JOIN {p}_dp x ON x.key = y.key AND x.i = len(a)),
{p}_rouge AS (SELECT key, round_even({_f1(_ratio("lcs", "na"), _ratio("lcs", "nb"))}, 4) AS rouge_l FROM {p}_lcs)"""


def sql_counts(p: str, source: str, key: str, g: str, r: str) -> str:
    """CTE ``<p>_counts(key, gl, rl, m1.., t1..)``."""
    def grams(side: str) -> str:
        ahead = [f"lead(t, {k}) OVER w" for k in range(1, 4)]
        gram = " ".join(f"WHEN {n} THEN " + " || ' ' || ".join(["t"] + ahead[:n - 1]) for n in range(1, 5))
        rows = f"SELECT key, unnest({side}) AS t, generate_subscripts({side}, 1) AS i FROM {p}_bt"
        return (f"SELECT key, n, gram, count(*) AS c FROM (SELECT key, n, CASE n {gram} END AS gram "
                f"FROM ({rows}), (VALUES (1), (2), (3), (4)) v(n) WINDOW w AS (PARTITION BY key, n ORDER BY i)) "
                f"WHERE gram IS NOT NULL GROUP BY ALL")
    sums = ", ".join(f"coalesce(sum(m) FILTER (n = {n}), 0) AS m{n}, greatest(any_value(gl) - {n - 1}, 0) AS t{n}" for n in range(1, 5))
    return f"""
{p}_bt AS (SELECT {key} AS key, {sql_tokens(f"coalesce({g}, '')")} AS g, {sql_tokens(f"coalesce({r}, '')")} AS r FROM {source}),
{p}_gg AS ({grams("g")}), {p}_rg AS ({grams("r")}),
{p}_hits AS (SELECT a.key, a.n, least(a.c, b.c) AS m FROM {p}_gg a JOIN {p}_rg b ON b.key = a.key AND b.n = a.n AND b.gram = a.gram),
{p}_sizes AS (SELECT key, len(g) AS gl, len(r) AS rl FROM {p}_bt),
{p}_counts AS (SELECT s.key, any_value(gl) AS gl, any_value(rl) AS rl, {sums}
               FROM {p}_sizes s LEFT JOIN {p}_hits h ON h.key = s.key GROUP BY s.key)"""


_BP = "CASE WHEN gl = 0 THEN 0.0 WHEN gl > rl THEN 1.0 ELSE exp(1 - rl / gl) END"
_SENTENCE = (f"CASE WHEN m1 = 0 OR gl = 0 OR rl = 0 THEN 0.0 ELSE round_even({_BP} * exp(("
             + " + ".join(f"ln(CASE WHEN m{n} = 0 THEN 0.1 ELSE m{n} END / greatest(t{n}, 1))" for n in range(1, 5))
             + ") / 4), 4) END")
_CORPUS = (f"CASE WHEN m1 = 0 THEN 0.0 ELSE round_even({_BP} * exp(("
           + " + ".join(f"CASE WHEN m{n} = 0 THEN ln(2.2250738585072014e-308) ELSE ln(m{n} / t{n}) END" for n in range(1, 5))
           + ") / 4), 4) END")
_TOTALS = ", ".join(f"sum(m{n}) AS m{n}, sum(greatest(t{n}, 1)) AS t{n}" for n in range(1, 5))


def sql_bootstrap(p: str, source: str, n_bootstrap: int = 1000) -> str:
    """CTE ``<p>_ci(model, score, lower, upper)`` from ``source(model, score, u)``."""
    def fifth(added: str) -> str:
        return f"((((q * q) % {PRIME}) * x) % {PRIME} + {added}) % {PRIME}"
    square = f"(x * x) % {PRIME} AS q"
    return f"""
{p}_rows AS (SELECT model, score, u, row_number() OVER (PARTITION BY model, score ORDER BY u) - 1 AS i FROM {source}),
{p}_n AS (SELECT model, score, count(*) AS n FROM {source} GROUP BY ALL),
{p}_d0 AS (SELECT model, score, n, r, unnest(range(n)) AS j FROM {p}_n, range({n_bootstrap}) t(r)),
{p}_d1 AS (SELECT *, (r * 1000003 + j * 7919 + {42 * 104729}) % {PRIME} AS x FROM {p}_d0),
{p}_d2 AS (SELECT * EXCLUDE (x), {fifth("12345")} AS x FROM (SELECT *, {square} FROM {p}_d1)),
{p}_d3 AS (SELECT * EXCLUDE (x, q), {fifth("j * 31 + 67890")} AS x FROM (SELECT * EXCLUDE (q), {square} FROM {p}_d2)),
{p}_d4 AS (SELECT * EXCLUDE (x, q), x AS fine, {fifth("0")} AS x FROM (SELECT *, {square} FROM {p}_d3)),
{p}_draws AS (SELECT model, score, n, r, (x * n + (fine * n) // {PRIME}) // {PRIME} AS i FROM {p}_d4),
{p}_means AS (SELECT d.model, d.score, r, sum(u) / max(n) / 10000 AS mean FROM {p}_draws d
              JOIN {p}_rows s ON s.model = d.model AND s.score = d.score AND s.i = d.i GROUP BY d.model, d.score, r),
{p}_ci AS (SELECT model, score, round_even(quantile_cont(mean, 0.025), 4) AS lower,
                  round_even(quantile_cont(mean, 0.975), 4) AS upper FROM {p}_means GROUP BY ALL)"""


def sql_units(x: str) -> str:
    return f"CAST(round_even({x} * 10000, 0) AS BIGINT)"


def _mean(x: str) -> str:
    return f"round_even(sum({sql_units(x)}) / count({x}) / 10000, 4)"


# ---- item scores --------------------------------------------------------

def _order_items(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines on both sides: open lines are generated, kept lines are
    the reference."""
    lines = line_items(spark, sf).withColumn("item", parse.normalise_item(F.col("item")))
    sides = F.array_compact(F.array(
        F.when(F.col("l_linestatus") == "O", F.lit(True)), F.when(F.col("l_returnflag") != "R", F.lit(False))))
    return lines.select("l_orderkey", "item", F.explode(sides).alias("is_generated"))


def _order_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score.item_table_scores(_order_items(spark, sf), ["l_orderkey"], "item", "is_generated")


_ORDER_SCORES_SQL = f"""
{LINE_ITEMS_SQL},
g AS (SELECT DISTINCT l_orderkey, plain FROM line_items WHERE l_linestatus = 'O'),
r AS (SELECT DISTINCT l_orderkey, plain FROM line_items WHERE l_returnflag <> 'R'),
both_sides AS (SELECT l_orderkey, count(*) AS n FROM g JOIN r USING (l_orderkey, plain) GROUP BY l_orderkey),
gn AS (SELECT l_orderkey, count(*) AS n FROM g GROUP BY l_orderkey),
rn AS (SELECT l_orderkey, count(*) AS n FROM r GROUP BY l_orderkey),
counted AS (SELECT coalesce(gn.l_orderkey, rn.l_orderkey) AS l_orderkey, coalesce(gn.n, 0) AS n_generated,
                   coalesce(rn.n, 0) AS n_reference, coalesce(b.n, 0) AS both_n
            FROM gn FULL JOIN rn ON gn.l_orderkey = rn.l_orderkey
            LEFT JOIN both_sides b ON b.l_orderkey = coalesce(gn.l_orderkey, rn.l_orderkey)),
order_scores AS (SELECT l_orderkey, n_generated, n_reference, {sql_prf("counted", "both_n", "n_generated", "n_reference", "")} FROM counted)"""


@query(f"""
WITH {_ORDER_SCORES_SQL} SELECT l_orderkey, n_generated, n_reference, "precision", recall, f1 FROM order_scores""")
def item_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _order_scores(spark, sf)


@query(f"""
WITH {_TURNS_SQL}, w AS (SELECT conv_id, turn, {sql_words("text")} AS g, {sql_words("coalesce(before, '')")} AS r FROM tn)
SELECT conv_id, turn, round_even(len(list_intersect(g, r)) / nullif(len(g), 0), 4) AS "precision",
       round_even(len(list_intersect(g, r)) / nullif(len(r), 0), 4) AS recall FROM w""")
def legacy_pr(spark: SparkSession, sf: str) -> DataFrame:
    return _word_scores(spark, sf).select("conv_id", "turn", "precision", "recall")


def _word_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn against the one before it; the first of a conversation has none."""
    rows = _turns(spark, sf).withColumns({"g": words(F.col("text")), "r": words(F.coalesce("before", F.lit("")))})
    return score.legacy_scores(rows, "g", "r")


@query(f"""
WITH {_TURNS_SQL}, w AS (SELECT turn, {sql_words("text")} AS g, {sql_words("coalesce(before, '')")} AS r FROM tn),
s AS (SELECT turn, round_even(len(list_intersect(g, r)) / nullif(len(g), 0), 4) AS p,
             round_even(len(list_intersect(g, r)) / nullif(len(r), 0), 4) AS q FROM w),
ek AS (SELECT conv_id * 1000 + turn AS id, * FROM tn), {sql_counts("x", "ek", "id", "text", "before")},
b AS (SELECT turn, {_SENTENCE} AS bleu FROM x_counts JOIN ek ON id = key)
SELECT turn, count(*) AS n_rows, {_mean("p")} AS avg_precision, {_mean("q")} AS avg_recall,
       (SELECT {_mean("bleu")} FROM b WHERE b.turn = s.turn) AS avg_bleu_sentence
FROM s GROUP BY turn""")
def prompt_means(spark: SparkSession, sf: str) -> DataFrame:
    """Word precision, recall and BLEU per turn number, which stands for the prompt template."""
    scored = score.sentence_bleu(score.ngram_matches(_word_scores(spark, sf), "text", "before"))
    return score.prompt_means(scored, "turn", ["precision", "recall", "bleu_sentence"])


@query(f"""
WITH nb AS (SELECT a.doc_id, string_split(a.text, chr(10)) AS r, string_split(b.text, chr(10)) AS g
            FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
j AS (SELECT doc_id, array_to_string(g, ' ') AS g, array_to_string(r, ' ') AS r FROM nb), {sql_counts("x", "j", "doc_id", "g", "r")}
SELECT key AS doc_id, {_SENTENCE} AS bleu FROM x_counts""")
def line_bleu(spark: SparkSession, sf: str) -> DataFrame:
    """BLEU of the lines of a document against those of the one before."""
    pairs = _neighbours(spark, sf).where(F.col("generated").isNotNull())
    lines = pairs.select("doc_id", F.split("generated", "\n").alias("g"), F.split("reference", "\n").alias("r"))
    return score.line_bleu(lines, "g", "r").select("doc_id", "bleu")


# ---- text scores --------------------------------------------------------

@query(f"""
WITH RECURSIVE {_TURNS_SQL}, ek AS (SELECT conv_id * 1000 + turn AS id, * FROM tn), {sql_rouge("x", "ek", "id", "text", "before")}
SELECT key AS row_index, rouge_l FROM x_rouge""")
def rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn against the one before it."""
    rows = _turns(spark, sf).withColumn("row_index", F.col("conv_id") * 1000 + F.col("turn"))
    return score.rouge_l(rows, "text", "before", stem=False).select("row_index", "rouge_l")


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text with the next document's as the generated one."""
    d = texts(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("reference"))
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("reference").alias("generated"))
    return d.join(following, "doc_id", "left")


_NEIGHBOURS_SQL = """
nb AS (SELECT a.doc_id, a.lang, a.text AS reference, b.text AS generated
       FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1)"""


@query()
def rouge_l_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    return score.rouge_l(_neighbours(spark, sf), "generated", "reference").select("doc_id", "rouge_l")


@query(f"""
WITH {_NEIGHBOURS_SQL}, {sql_counts("x", "nb", "doc_id", "generated", "reference")}
SELECT key AS doc_id, {_SENTENCE} AS bleu_sentence FROM x_counts""")
def sentence_bleu(spark: SparkSession, sf: str) -> DataFrame:
    counts = score.ngram_matches(_neighbours(spark, sf), "generated", "reference")
    return score.sentence_bleu(counts).select("doc_id", "bleu_sentence")


@query(f"""
WITH {_NEIGHBOURS_SQL}, {sql_counts("x", "nb", "doc_id", "generated", "reference")},
t AS (SELECT lang, count(*) AS n_samples, sum(gl) AS gl, sum(rl) AS rl, {_TOTALS} FROM x_counts JOIN nb ON doc_id = key GROUP BY lang)
SELECT lang, n_samples, {_CORPUS} AS bleu_corpus FROM t""")
def corpus_bleu(spark: SparkSession, sf: str) -> DataFrame:
    counts = score.ngram_matches(_neighbours(spark, sf), "generated", "reference")
    return score.corpus_bleu(counts, ["lang"])


# ---- embeddings ---------------------------------------------------------

@query("""
WITH v AS (SELECT vec_id, vec_id // 32 AS pair_id, (vec_id // 16) % 2 AS side, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT g.pair_id, g.vec_id AS gi, r.vec_id AS ri, list_cosine_similarity(g.e, r.e) AS s
      FROM v g JOIN v r ON r.pair_id = g.pair_id AND r.side = 0 WHERE g.side = 1),
p AS (SELECT pair_id, avg(s) AS p FROM (SELECT pair_id, gi, max(s) AS s FROM c GROUP BY ALL) GROUP BY pair_id),
q AS (SELECT pair_id, avg(s) AS r FROM (SELECT pair_id, ri, max(s) AS s FROM c GROUP BY ALL) GROUP BY pair_id)
SELECT pair_id, coalesce(round_even(p, 4), 0) AS "precision", coalesce(round_even(r, 4), 0) AS recall,
       coalesce(round_even(2 * p * r / (p + r), 4), 0) AS f1
FROM (SELECT DISTINCT pair_id FROM v) LEFT JOIN p USING (pair_id) LEFT JOIN q USING (pair_id)""")
def greedy_match_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen vectors make a text; an even text is the reference of the next.
    The last text may have no partner; it stays and scores 0."""
    t = _vector_texts(spark, sf).withColumn("pair_id", F.floor(F.col("text_id") / 2))
    pairs = score.pair_vectors(t.where(F.col("text_id") % 2 == 1), t.where(F.col("text_id") % 2 == 0), "pair_id")
    scored = score.greedy_match(pairs, "g", "r", "")
    return scored.select("pair_id", *[F.bround(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def _vector_texts(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").withColumn("text_id", F.floor(F.col("vec_id") / 16))
    return score.gather_vectors(v, "text_id", "vec_id", "embedding", most=16)


def _embedded(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Embedding scores of rows: an encoder's output is one array of vectors
    per text, joined by the text's number; an empty text has none."""
    encoded = _vector_texts(spark, sf)
    n = encoded.agg(F.count("*")).scalar()

    def side(column: str, name: str, shift: int) -> DataFrame:
        at = rows.select("row_index", F.when(F.col(column) != "", F.pmod(F.col("row_index") + shift, n)).alias("text_id"))
        return at.join(encoded, "text_id", "left").select("row_index", F.col("vectors").alias(name))

    pairs = side("gen_instructions", "g", 1).join(side("ref_instructions", "r", 0), "row_index")
    scored = score.greedy_match(pairs, "g", "r").drop("g", "r")
    return scored.join(rows.select("row_index", "model_id"), "row_index")


_EMBEDDED_SQL = """
vk AS (SELECT vec_id, vec_id // 16 AS text_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
tx AS (SELECT key, CASE WHEN gbody <> '' THEN (key + 1) % n END AS gt, CASE WHEN rbody <> '' THEN key % n END AS rt
       FROM parsed, (SELECT count(DISTINCT text_id) AS n FROM vk)),
ck AS (SELECT tx.key, g.vec_id AS gi, r.vec_id AS ri, list_cosine_similarity(g.e, r.e) AS s
       FROM tx JOIN vk g ON g.text_id = gt JOIN vk r ON r.text_id = rt),
pk AS (SELECT key, avg(s) AS p FROM (SELECT key, gi, max(s) AS s FROM ck GROUP BY ALL) GROUP BY key),
qk AS (SELECT key, avg(s) AS r FROM (SELECT key, ri, max(s) AS s FROM ck GROUP BY ALL) GROUP BY key),
emb AS (SELECT tx.key, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(2 * p * r / (p + r), 0) AS f
        FROM tx LEFT JOIN pk ON pk.key = tx.key LEFT JOIN qk ON qk.key = tx.key)"""


# ---- scored rows, means, intervals ---------------------------------------

_SCORED_SQL = f"""
{CONV_EVAL_SQL}, {sql_parse("r", "ev", "row_index", "reference_text")}, {sql_parse("g", "ev", "row_index", "generated_text")},
parsed AS (SELECT r.key, r.name AS rname, r.items AS ritems, r.body AS rbody, g.name AS gname, g.items AS gitems, g.body AS gbody
           FROM r_parsed r JOIN g_parsed g ON g.key = r.key),
sets AS (SELECT key, {sql_normalised("gitems")} AS gs, {sql_normalised("ritems")} AS rs FROM parsed),
prf AS (SELECT key, {sql_prf("sets", "len(list_intersect(gs, rs))", "len(gs)", "len(rs)", "ingredient_")} FROM sets),
{sql_rouge("s", "parsed", "key", "gbody", "rbody")}, {sql_counts("s", "parsed", "key", "gbody", "rbody")},
scored AS (SELECT p.key, model_id, reference_text, generated_text, rname, gname, gbody, array_to_string(gitems, '|') AS gitems,
                  ingredient_f1, ingredient_precision, ingredient_recall, rouge_l, {_SENTENCE} AS bleu_sentence
           FROM parsed p JOIN ev ON row_index = p.key JOIN prf ON prf.key = p.key JOIN s_rouge ON s_rouge.key = p.key
           JOIN s_counts ON s_counts.key = p.key)"""

_FIVE = "ingredient_f1, ingredient_precision, ingredient_recall, rouge_l, bleu_sentence"


@query(f"""
WITH RECURSIVE {_SCORED_SQL}
SELECT key AS row_index, model_id, coalesce(gname, '') AS gen_name, gbody AS gen_instructions, {_FIVE} FROM scored""")
def scored_with_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a generated text stay, with empty fields and zero scores."""
    rows = score.score_rows(conv_eval(spark, sf), stem=False)
    return rows.select("row_index", "model_id", "gen_name", "gen_instructions", *score.SCORES)


@query(f"""
WITH RECURSIVE {_SCORED_SQL}
SELECT key AS row_index, 'kept ' || model_id AS user_message, rname AS ref_name, gitems AS gen_ingredients, {_FIVE} FROM scored""")
def rescore(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows with stale fields and scores, parsed and scored again."""
    stored = conv_eval(spark, sf).withColumns({
        "user_message": F.concat(F.lit("kept "), "model_id"), "ref_name": F.lit("stale"),
        "gen_ingredients": F.array(F.lit("stale")), "rouge_l": F.lit(0.5), "ingredient_f1": F.lit(0.5)})
    rows = score.score_rows(stored, stem=False)
    return rows.select("row_index", "user_message", "ref_name", F.array_join("gen_ingredients", "|").alias("gen_ingredients"),
                       *score.SCORES)


def _priority_scores(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("model_id"))
    return _order_scores(spark, sf).join(o, "l_orderkey").select("model_id", "f1", "recall")


@query(f"""
WITH {_ORDER_SCORES_SQL}
SELECT o_orderpriority AS model_id, count(*) AS n_samples, round_even(sum({sql_units("f1")}) / count(*) / 10000, 4) AS f1_mean,
       round_even(sum({sql_units("recall")}) / count(*) / 10000, 4) AS recall_mean
FROM order_scores JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def score_means(spark: SparkSession, sf: str) -> DataFrame:
    return score.score_means(_priority_scores(spark, sf), ["model_id"], ["f1", "recall"])


@query(f"""
WITH {_ORDER_SCORES_SQL},
b_src AS (SELECT o_orderpriority AS model, 'f1' AS score, {sql_units("f1")} AS u FROM order_scores JOIN orders ON o_orderkey = l_orderkey),
{sql_bootstrap("b", "b_src")}
SELECT model AS model_id, lower AS f1_ci_lower, upper AS f1_ci_upper FROM b_ci""")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return score.bootstrap_ci(_priority_scores(spark, sf), ["model_id"], ["f1"])


@query(f"""
WITH {_ORDER_SCORES_SQL},
b_src AS (SELECT 'all' AS model, 'recall' AS score, {sql_units("recall")} AS u FROM order_scores),
{sql_bootstrap("b", "b_src")}
SELECT model AS model_id, lower AS recall_ci_lower, upper AS recall_ci_upper FROM b_ci""")
def bootstrap_ci_large(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of one group that is the whole table."""
    rows = _order_scores(spark, sf).select(F.lit("all").alias("model_id"), "recall")
    return score.bootstrap_ci(rows, ["model_id"], ["recall"])


def _ci_columns_sql(name: str, out: str) -> str:
    return ", ".join(f"(SELECT {side} FROM b_ci WHERE model = c.model_id AND score = '{name}') AS {out}_ci_{side}"
                     for side in ("lower", "upper"))


@query(f"""
WITH RECURSIVE {_SCORED_SQL}, {_EMBEDDED_SQL},
b_src AS (SELECT model_id AS model, 'i' AS score, {sql_units("ingredient_f1")} AS u FROM scored UNION ALL
          SELECT model_id, 'r', {sql_units("rouge_l")} FROM scored UNION ALL
          SELECT model_id, 'e', {sql_units("f")} FROM emb JOIN scored USING (key)),
{sql_bootstrap("b", "b_src")},
bleu AS (SELECT model_id, {_CORPUS} AS bleu_corpus FROM (SELECT model_id, sum(gl) AS gl, sum(rl) AS rl, {_TOTALS}
         FROM s_counts JOIN ev ON row_index = key GROUP BY model_id)),
e AS (SELECT model_id, round_even(sum({sql_units("f")}) / count(*) / 10000, 4) AS bertscore_mean_f1,
             round_even(sum({sql_units("p")}) / count(*) / 10000, 4) AS bertscore_mean_precision,
             round_even(sum({sql_units("r")}) / count(*) / 10000, 4) AS bertscore_mean_recall
      FROM emb JOIN scored USING (key) GROUP BY model_id),
c AS (SELECT model_id, count(*) AS n_samples, round_even(sum({sql_units("ingredient_f1")}) / count(*) / 10000, 4) AS ingredient_f1_mean,
             round_even(sum({sql_units("rouge_l")}) / count(*) / 10000, 4) AS rouge_l_mean FROM scored GROUP BY model_id)
SELECT c.*, {_ci_columns_sql("i", "ingredient_f1")}, {_ci_columns_sql("r", "rouge_l")}, bleu_corpus,
       e.* EXCLUDE (model_id), {_ci_columns_sql("e", "bertscore")}
FROM c JOIN bleu USING (model_id) JOIN e USING (model_id)""")
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    rows = score.score_rows(conv_eval(spark, sf), stem=False, with_counts=True)
    rows = save_and_reread(rows, "scored")
    return score.scorecard(rows, embedding=save_and_reread(_embedded(spark, sf, rows), "embedded"))


@query()
def scorecard_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The scorecard over whole documents, with stemming, without embeddings.
    Rows are stored with titles, scores and counts: both texts, item lists and
    bodies beside them are nine times the documents, and nothing reads them.
    They are few bytes, so they are brought together into files of a usual size."""
    rows = score.score_rows(doc_eval(spark, sf), with_counts=True, with_parts=False).drop("reference_text", "generated_text")
    return score.scorecard(save_and_reread(rows.hint("rebalance"), "scored"))


def _lookup(row: dict) -> dict:
    title, found, _ = row["prompt"].partition(".")
    if not found:
        raise ValueError("no sentence")
    return {"generated_text": f"**{title}**\n\n**Instructions:**\n{row['prompt']}"}


_GENERATED_SQL = """
SELECT doc_id, CASE WHEN contains(text, '.') THEN '**' || split_part(text, '.', 1) || '**' || chr(10) || chr(10)
       || '**Instructions:**' || chr(10) || text ELSE '' END AS generated_text,
       CASE WHEN NOT contains(text, '.') THEN 'ValueError: no sentence' END AS error
FROM documents"""


@query(_GENERATED_SQL)
def generate_with(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's generator; it raises on texts without a full stop, which get
    an empty text and the error."""
    rows = texts(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return score.score_with(rows, _lookup, "generated_text string", {"generated_text": ""}).drop("prompt")


def _lookups(rows: list[dict]) -> list[dict]:
    return [_lookup(row) for row in rows]


@query(_GENERATED_SQL)
def generate_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same generator taking many rows at a time; a batch is halved down to the rows it fails on."""
    rows = texts(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return score.score_batches(rows, _lookups, "generated_text string", {"generated_text": ""}).drop("prompt")
