"""Stand-in inputs that Spark derives from the given tables, with their SQL."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textjobs.functions.text import TOKEN_GAP, WS, tokens, wstrip_long
from textjobs.operators.formatting import response_text
from textjobs.plans.registry import sql_lines, sql_parts, sql_strip, sql_tokens, texts

STYLES = ["bullet", "comma", "hash", "untitled"]


def words(text: Column) -> Column:
    """Words of a text without commas and full stops, used as its item list."""
    return tokens(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("")))


def recipe_text(title: Column, text: Column, style: Column) -> Column:
    """A sectioned text in one of four output styles."""
    plain = wstrip_long(F.regexp_replace(text, "[.,]+", ""))

    def listed(before: str, between: str) -> Column:
        """All words, each after ``before``: every gap is replaced in one pass over the text."""
        return F.when(plain == "", "").otherwise(F.concat(F.lit(before), F.regexp_replace(plain, TOKEN_GAP, between + before)))

    bullets, commas = listed("- 2 cups ", "\n"), listed("1 tbsp ", ", ")
    untitled = F.concat(F.lit("**Ingredients:**\n"), commas, F.lit("\n\n**Instructions:**\n**Step 1:**\n"), text)
    hashed = F.concat(F.lit("### "), title, F.lit("\n\n### Ingredients\n"), commas, F.lit("\n\n### Instructions\n"), text)
    return (
        F.when(style == "bullet", response_text(title, bullets, text))
        .when(style == "comma", response_text(title, commas, text))
        .when(style == "hash", hashed).otherwise(untitled)
    )


def sql_words(text: str) -> str:
    return (f"list_filter(list_transform({sql_tokens(text)}, lambda t: regexp_replace(t, '[.,]+', '', 'g')), "
            f"lambda t: t <> '')")


def sql_recipe(title: str, text: str, style: str) -> str:
    bullets = f"array_to_string(list_transform({sql_words(text)}, lambda w: '- 2 cups ' || w), chr(10))"
    commas = f"array_to_string(list_transform({sql_words(text)}, lambda w: '1 tbsp ' || w), ', ')"
    nl = "chr(10)"

    def bold(items: str) -> str:
        return (f"'**' || {sql_strip(title)} || '**' || {nl} || {nl} || {nl} || '**Ingredients:**' || {nl} || {sql_strip(items)} "
                f"|| {nl} || {nl} || '**Instructions:**' || {nl} || {sql_strip(text)}")
    return f"""CASE {style} WHEN 'bullet' THEN {bold(bullets)} WHEN 'comma' THEN {bold(commas)}
      WHEN 'hash' THEN '### ' || {title} || {nl} || {nl} || '### Ingredients' || {nl} || {commas} || {nl} || {nl}
                       || '### Instructions' || {nl} || {text}
      ELSE '**Ingredients:**' || {nl} || {commas} || {nl} || {nl} || '**Instructions:**' || {nl} || '**Step 1:**' || {nl} || {text} END"""


# ---- recipes from documents ---------------------------------------------

DOC_COLUMNS = ["doc_id", "lang", "source", "text"]


def _doc_style(lang: Column) -> Column:
    return F.when(lang == "en", "bullet").when(lang == "fr", "comma").when(lang == "de", "hash").otherwise("untitled")


def _doc_recipe(side: str = "") -> Column:
    doc_id, lang, source, text = (F.col(side + c) for c in DOC_COLUMNS)
    title = F.concat(F.lit("Dish "), source, F.lit(" "), doc_id.cast("string"))
    return recipe_text(title, text, _doc_style(lang))


def doc_recipes(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select("doc_id", "lang", "source", _doc_recipe().alias("recipe"))


DOC_RECIPES_SQL = f"""
doc_recipes AS (SELECT doc_id, lang, source, {sql_recipe("('Dish ' || source || ' ' || doc_id)", "text", "style")} AS recipe
  FROM (SELECT *, CASE lang WHEN 'en' THEN 'bullet' WHEN 'fr' THEN 'comma' WHEN 'de' THEN 'hash' ELSE 'untitled' END AS style
        FROM documents))"""


def doc_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Reference: a document's recipe; generated: the next one's; model: its
    language.  The last document has no generated text."""
    d = texts(spark, sf, "documents").select(*DOC_COLUMNS)
    following = d.select((F.col("doc_id") - 1).alias("row_index"), *[F.col(c).alias(f"next_{c}") for c in DOC_COLUMNS])
    # the documents meet before they are rendered: a recipe is three times as long as its text
    pairs = d.withColumn("row_index", F.col("doc_id")).join(following, "row_index", "left")
    return pairs.select("row_index", F.col("lang").alias("model_id"), _doc_recipe().alias("reference_text"),
                        _doc_recipe("next_").alias("generated_text"))


DOC_EVAL_SQL = DOC_RECIPES_SQL + """,
ev AS (SELECT a.doc_id AS row_index, a.lang AS model_id, a.recipe AS reference_text, b.recipe AS generated_text
       FROM doc_recipes a LEFT JOIN doc_recipes b ON b.doc_id = a.doc_id + 1)"""


# ---- recipes from conversations -----------------------------------------

def conv_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Reference: every turn as a recipe; generated: the turn after the next,
    the same speaker's; model: the turn number."""
    c = texts(spark, sf, "conversations")
    style = (F.when(F.col("turn") == 1, "bullet").when(F.col("turn") == 3, "comma")
             .when(F.col("turn") == 5, "hash").otherwise("untitled"))
    title = F.concat(F.lit("Dish "), F.col("conv_id").cast("string"))
    r = c.select("conv_id", "turn", recipe_text(title, F.col("text"), style).alias("recipe"))
    generated = r.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("recipe").alias("generated_text"))
    return r.join(generated, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("model_id"),
        F.col("recipe").alias("reference_text"), "generated_text")


CONV_EVAL_SQL = f"""
conv_recipes AS (SELECT conv_id, turn, {sql_recipe("('Dish ' || conv_id)", "text", "style")} AS recipe
  FROM (SELECT *, CASE turn WHEN 1 THEN 'bullet' WHEN 3 THEN 'comma' WHEN 5 THEN 'hash' ELSE 'untitled' END AS style
        FROM conversations)),
ev AS (SELECT a.conv_id * 1000 + a.turn AS row_index, 'turn ' || a.turn AS model_id, a.recipe AS reference_text,
              b.recipe AS generated_text
       FROM conv_recipes a LEFT JOIN conv_recipes b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2)"""


# ---- SQL form of the section parse: windows over lines -------------------

def sql_split_items(x: str) -> str:
    bare = f"regexp_replace(l, '^[-*•][{WS}]*', '')"
    return (f"CASE WHEN len({sql_lines(x)}) > 1 THEN flatten(list_transform({sql_lines(x)}, lambda l: {sql_parts(bare)})) "
            f"ELSE {sql_parts(x)} END")


_HEAD = f"(?is)(?:#{{1,3}}[{WS}]*)?[*_]*"


def sql_parse(p: str, source: str, key: str, text: str) -> str:
    """CTEs that end in ``<p>_parsed(key, name, items, body)``."""
    loose = f"regexp_extract(t, '{_HEAD}ingredients?[*_]*:?[*_]*[{WS}]*\\n(.*)$', 1)"
    loose = f"regexp_replace({loose}, '(?is)\\n[{WS}]*(?:#{{1,3}}[{WS}]*)?[*_]*instructions?.*$', '')"
    body = f"regexp_extract(t, '{_HEAD}instructions?[*_]*:?[*_]*[{WS}]*\\n(.*)$', 1)"
    return f"""
{p}_src AS (SELECT {key} AS key, coalesce({text}, '') AS t FROM {source}),
{p}_lines AS (SELECT key, unnest(string_split({sql_strip("t")}, chr(10))) AS raw,
                     generate_subscripts(string_split({sql_strip("t")}, chr(10)), 1) AS n FROM {p}_src),
{p}_kinds AS (SELECT key, n, {sql_strip("raw")} AS s FROM {p}_lines),
{p}_marks AS (SELECT *, CASE WHEN starts_with(s, '**') AND contains(lower(s), 'ingredient') THEN 'i'
                             WHEN starts_with(s, '**') AND contains(lower(s), 'instruction') THEN 'b'
                             WHEN starts_with(s, '**') AND ends_with(s, '**') THEN 'x' END AS kind FROM {p}_kinds),
{p}_sections AS (SELECT *, last_value(CASE WHEN kind IN ('i', 'b') THEN kind END IGNORE NULLS) OVER w AS section,
                        max(CASE WHEN kind IN ('i', 'b') THEN n END) OVER w AS head,
                        max(CASE WHEN kind = 'x' THEN n END) OVER w AS last_bold
                 FROM {p}_marks WINDOW w AS (PARTITION BY key ORDER BY n)),
{p}_content AS (SELECT key, n, section, s FROM {p}_sections
                WHERE coalesce(kind, '') NOT IN ('i', 'b') AND s <> ''
                  AND (section = 'b' OR (section = 'i' AND coalesce(last_bold, 0) < head))),
{p}_texts AS (SELECT key, coalesce(string_agg(s, chr(10) ORDER BY n) FILTER (section = 'i'), '') AS i,
                     coalesce(string_agg(s, chr(10) ORDER BY n) FILTER (section = 'b'), '') AS b
              FROM {p}_content GROUP BY key),
{p}_names AS (SELECT key, arg_min({sql_strip("trim(s, '*')")}, n) AS name FROM {p}_marks
              WHERE kind = 'x' AND length(s) > 4 GROUP BY key),
{p}_strict AS (SELECT r.key, t, coalesce(name, '') AS name, coalesce(i, '') AS i, coalesce(b, '') AS b
               FROM {p}_src r LEFT JOIN {p}_texts x ON x.key = r.key LEFT JOIN {p}_names m ON m.key = r.key),
{p}_loose AS (SELECT *, CASE WHEN i = '' THEN {sql_strip(loose)} ELSE i END AS i2,
                     CASE WHEN b = '' THEN {sql_strip(body)} ELSE b END AS b2 FROM {p}_strict),
{p}_parsed AS (SELECT key, name, {sql_split_items("i2")} AS items, b2 AS body FROM {p}_loose)"""


def sql_normalised(items: str) -> str:
    """Distinct normalised items of a list."""
    from textjobs.operators.parse import QUANTITY, QUANTITY_UNIT
    one = f"regexp_replace({sql_strip('lower(t)')}, '{QUANTITY_UNIT}', '')"
    one = sql_strip(f"regexp_replace({one}, '^{QUANTITY}', '')")
    return f"list_distinct(list_filter(list_transform({items}, lambda t: {one}), lambda t: t <> ''))"
