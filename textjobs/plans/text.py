"""Registered queries: prompts, chat texts, parsing, item lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textjobs.functions.fixed import (
    ADAPTATION_FRAME, ADAPTATIONS, ASSISTANT_OPENER, COURSES, DIETS, REGIONS, SEED_SETS, SYSTEM_PROMPT,
)
from textjobs.functions.text import WS, wstrip
from textjobs.operators import formatting, parse, session
from textjobs.plans.inputs import (
    DOC_RECIPES_SQL, doc_recipes, sql_parse, sql_split_items, sql_words, words,
)
from textjobs.plans.registry import query, sql_lines, sql_strip, sql_tokens, table, texts

# ---- prompts and responses ----------------------------------------------

_VOWEL = "CASE WHEN lower(substr(d, 1, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""
WITH x AS (SELECT *, CASE WHEN p_size < 20 THEN 'Vegan ' ELSE '' END || p_type AS d FROM part)
SELECT p_partkey, 'Generate ' || {_VOWEL} || ' ' || d || ' ' || CASE WHEN p_retailprice < 1000 THEN 'side dish ' ELSE '' END
       || 'recipe for ' || p_name AS user_message, {_quoted(SYSTEM_PROMPT)} AS system_prompt FROM x""")
def build_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" \n")).alias("TranslatedRecipeName"), F.col("p_type").alias("Cuisine"),
        F.when(F.col("p_size") < 20, "Vegan ").when(F.col("p_size") < 30, "  ").alias("Diet"),
        F.when(F.col("p_retailprice") < 1000, " Side Dish").alias("Course"),
        F.lit("a").alias("TranslatedIngredients"), F.lit("b").alias("TranslatedInstructions"))
    return formatting.build_pairs(rows, ["p_partkey"]).select("p_partkey", "user_message", "system_prompt")


@query(f"WITH {DOC_RECIPES_SQL} SELECT doc_id, recipe FROM doc_recipes")
def build_responses(spark: SparkSession, sf: str) -> DataFrame:
    return doc_recipes(spark, sf).select("doc_id", "recipe")


@query(f"""
WITH x AS (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'Vegan' WHEN 'HOUSEHOLD' THEN 'Any Diet' END AS diet,
                  CASE WHEN c_nationkey < 8 THEN 'Any Region' WHEN c_nationkey < 16 THEN 'Andhra' END AS region,
                  CASE WHEN c_acctbal > 5000 THEN 'Under 30 min' WHEN c_acctbal > 3000 THEN '1+ hours' ELSE 'Any Time' END AS tm
           FROM customer),
y AS (SELECT *, concat_ws(' ', CASE WHEN diet <> 'Any Diet' THEN diet END, CASE WHEN region <> 'Any Region' THEN region END) AS chosen FROM x),
z AS (SELECT *, CASE WHEN c_acctbal < 1000 THEN CASE WHEN chosen = '' THEN 'Indian' ELSE chosen END
                     ELSE trim(chosen || ' recipe') END AS d FROM y)
SELECT c_custkey, 'Generate ' || {_VOWEL} || ' ' || d || CASE WHEN c_acctbal < 1000 THEN ' recipe for ' || c_name ELSE
       CASE tm WHEN 'Under 30 min' THEN ' ready in under 30 minutes' WHEN '1+ hours' THEN ' ready in under 1+ hours minutes' ELSE '' END
       || ' using these ingredients: ' || CASE WHEN c_nationkey > 20 THEN 'paneer, spinach, tomato' ELSE c_mktsegment || ', ' || c_name END END
       AS user_message FROM z""")
def build_form_requests(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_acctbal") < 1000, F.concat(F.lit(" "), "c_name")).otherwise(" ")
    items = F.when(F.col("c_nationkey") > 20, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment", "c_name"))
    diet = F.when(F.col("c_mktsegment") == "BUILDING", "Vegan").when(F.col("c_mktsegment") == "HOUSEHOLD", "Any Diet")
    region = F.when(F.col("c_nationkey") < 8, "Any Region").when(F.col("c_nationkey") < 16, "Andhra")
    time = (F.when(F.col("c_acctbal") > 5000, "Under 30 min").when(F.col("c_acctbal") > 3000, "1+ hours")
            .otherwise("Any Time"))
    return c.select("c_custkey", formatting.form_request_text(name, items, diet, region, time).alias("user_message"))


def _adapted_sql(change: str) -> str:
    before, middle, after = ADAPTATION_FRAME.split("%s")
    return f"{_quoted(before)} || text || {_quoted(middle)} || {change} || {_quoted(after)}"


_PRESETS = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in ADAPTATIONS)


@query(f"""
SELECT doc_id, preset, {_adapted_sql("change")} AS user_message
FROM documents, (VALUES {_PRESETS}) AS o(preset, change) WHERE {sql_strip("text")} <> ''""")
def build_adaptations(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.build_adaptations(texts(spark, sf, "documents"), "text", ["doc_id"])


@query("""
SELECT p_partkey, i AS prompt_number, replace(t, '{Items}', p_name || ' x') AS prompt
FROM part, (VALUES (1, 'Use only: {Items}'), (2, '{Items} and nothing else than {Items}'), (3, 'no slot')) AS o(i, t)""")
def template_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" x")).alias("items"))
    templates = ["Use only: {Items}", "{Items} and nothing else than {Items}", "no slot"]
    return formatting.fill_templates(rows, "items", templates, ["p_partkey"], "{Items}")


# ---- chat ---------------------------------------------------------------

def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """All turns of all conversations, each with the example that ends in it."""
    return formatting.turn_messages(table(spark, sf, "conversations"), "conv_id", ["turn"], "role", "text")


_TURNS_SQL = """
tn AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before_role, lag(text) OVER w AS before,
              last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER w AS system
       FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def _shown_messages() -> Column:
    return F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "\n")


@query(f"""
WITH {_TURNS_SQL},
x AS (SELECT conv_id, turn, list_filter([CASE WHEN role <> 'system' THEN 'system=' || system END,
        CASE WHEN role = 'assistant' AND before_role = 'user' THEN 'user=' || before END, role || '=' || text], lambda m: m IS NOT NULL) AS m FROM tn)
SELECT conv_id, turn, len(m) AS n_messages, array_to_string(m, chr(10)) AS messages FROM x""")
def to_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.size("messages").alias("n_messages"), _shown_messages().alias("messages"))


def _whole_block_sql(role: str, content: str) -> str:
    return f"'<|start_header_id|>' || {role} || '<|end_header_id|>' || chr(10) || chr(10) || {content} || '<|eot_id|>'"


def _chat_sql(last: str) -> str:
    """CTE ``chats``: the chat of every turn's example; ``last`` is the condition under which the turn itself is in it."""
    head = _whole_block_sql("'system'", f"""'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 26 Jul 2024'
    || chr(10) || chr(10) || coalesce({sql_strip("system")}, '')""")
    asked = _whole_block_sql("'user'", sql_strip("before"))
    return f"""
chats AS (SELECT conv_id, turn, role, text, '<|begin_of_text|>' || {head}
          || CASE WHEN role = 'assistant' AND before_role = 'user' THEN {asked} ELSE '' END
          || CASE WHEN {last} THEN {_whole_block_sql("role", sql_strip("text"))} ELSE '' END AS chat FROM tn)"""


_CHAT_SQL = _chat_sql("role <> 'system'")


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", formatting.render_chat(F.col("messages")).alias("chat"))


@query(f"WITH {_TURNS_SQL}, {_CHAT_SQL} SELECT conv_id, turn, chat FROM chats")
def render_chat(spark: SparkSession, sf: str) -> DataFrame:
    return _chats(spark, sf)


@query(f"""
WITH {_TURNS_SQL}, {_CHAT_SQL}, x AS (SELECT *, length({sql_strip("text")}) + 10 AS n FROM chats)
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN length(chat) - n END AS target_start,
       CASE WHEN role = 'assistant' THEN n END AS target_length, role <> 'assistant' AS skipped FROM x""")
def completion_span(spark: SparkSession, sf: str) -> DataFrame:
    spans = formatting.completion_span(_chats(spark, sf), "chat")
    return spans.select("conv_id", "turn", "target_start", "target_length", "skipped")


@query(f"""
WITH {_TURNS_SQL}, {_chat_sql("role NOT IN ('system', 'assistant')")}
SELECT conv_id, turn, chat || {_quoted(ASSISTANT_OPENER)} AS prompt FROM chats""")
def generation_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """What a model is asked at every turn: its example without the answer, and the assistant's opener."""
    asked = F.filter("messages", lambda m: m["role"] != "assistant")
    return _turns(spark, sf).select("conv_id", "turn", formatting.render_chat(asked, opener=True).alias("prompt"))


_FRAGMENT = 2
_MESSAGES_SQL = f"""
placed AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS content,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations),
blocks AS (SELECT *, '<|begin_of_text|>' || {_whole_block_sql("'system'", f"""'Cutting Knowledge Date: December 2023' || chr(10)
    || 'Today Date: 26 Jul 2024' || chr(10) || chr(10) || CASE WHEN role = 'system' THEN {sql_strip("content")} ELSE '' END""")} AS head,
  {_whole_block_sql("role", sql_strip("content"))} AS block FROM placed),
shown AS (SELECT *, CASE WHEN pos > 0 THEN block WHEN role = 'system' THEN head ELSE head || block END AS chat FROM blocks)"""


@query(f"""
WITH {_MESSAGES_SQL}
SELECT conv_id, pos // {_FRAGMENT} AS fragment, pos // {_FRAGMENT} * {_FRAGMENT} AS first_message, count(*) AS n_messages,
       string_agg(role || '=' || content, chr(10) ORDER BY pos) AS messages, string_agg(chat, '' ORDER BY pos) AS chat
FROM shown GROUP BY conv_id, pos // {_FRAGMENT}""")
def conversation_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """All turns of all conversations, two to a fragment."""
    parts = formatting.conversation_fragments(table(spark, sf, "conversations"), "conv_id", ["turn"], "role", "text", _FRAGMENT)
    return parts.select("conv_id", "fragment", "first_message", F.size("messages").alias("n_messages"),
                        _shown_messages().alias("messages"), "chat")


@query(f"""
WITH {_MESSAGES_SQL}
SELECT conv_id, count(*) AS n_messages, string_agg(role || '=' || content, chr(10) ORDER BY pos) AS messages,
       string_agg(chat, '' ORDER BY pos) AS chat FROM shown GROUP BY conv_id""")
def whole_conversations(spark: SparkSession, sf: str) -> DataFrame:
    parts = formatting.conversation_fragments(table(spark, sf, "conversations"), "conv_id", ["turn"], "role", "text", _FRAGMENT)
    whole = formatting.whole_conversations(parts, "conv_id")
    return whole.select("conv_id", F.size("messages").alias("n_messages"), _shown_messages().alias("messages"), "chat")


# ---- section parse ------------------------------------------------------

@query(f"""
WITH {DOC_RECIPES_SQL}, {sql_parse("r", "doc_recipes", "doc_id", "recipe")}
SELECT key AS doc_id, name, array_to_string(items, '|') AS items, len(items) AS n_items, body AS instructions FROM r_parsed""")
def parse_sections(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse.parse_sections(doc_recipes(spark, sf), "recipe")
    return parsed.select("doc_id", "name", F.array_join("ingredients", "|").alias("items"),
                         F.size("ingredients").alias("n_items"), "instructions")


@query(f"""
WITH {DOC_RECIPES_SQL}, {sql_parse("r", "doc_recipes", "doc_id", "recipe")}
SELECT key AS doc_id, CASE section WHEN 'i' THEN 'items' ELSE 'body' END AS section,
       row_number() OVER (PARTITION BY key, section ORDER BY n) - 1 AS line_no, s AS line FROM r_content""")
def section_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = parse.section_lines(doc_recipes(spark, sf), "recipe", ["doc_id"])
    return lines.select("doc_id", "section", "line_no", "line")


@query(f"""
WITH {DOC_RECIPES_SQL}, {sql_parse("r", "doc_recipes", "doc_id", "recipe")},
j AS (SELECT b AS stored, body AS fresh FROM r_strict s JOIN r_parsed p ON p.key = s.key)
SELECT count(*) AS n_rows, count(*) FILTER (stored = '') AS empty_before, count(*) FILTER (fresh = '') AS empty_after,
       round_even(count(*) FILTER (stored = '') * 100.0 / count(*), 1) AS empty_before_pct,
       round_even(count(*) FILTER (fresh = '') * 100.0 / count(*), 1) AS empty_after_pct FROM j""")
def parse_coverage(spark: SparkSession, sf: str) -> DataFrame:
    stored = doc_recipes(spark, sf).withColumn(
        "stored", F.when(F.contains("recipe", F.lit("**Instructions")), "filled").otherwise(""))
    return parse.parse_coverage(parse.parse_sections(stored, "recipe"), "stored", "instructions")


@query(f"SELECT doc_id, array_to_string(items, '|') AS items FROM (SELECT doc_id, {sql_split_items('text')} AS items FROM documents)")
def split_items(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select(
        "doc_id", F.array_join(parse.split_items(F.col("text")), "|").alias("items"))


def sql_display_items(block: str) -> str:
    """Display items of a block: commas in brackets are masked, then split."""
    masked = (f"array_to_string(list_transform(regexp_extract_all(replace({block}, chr(10), ' '), '[^()]+[()]?|[()]'), "
              "lambda p: CASE WHEN ends_with(p, ')') THEN replace(p, ',', chr(1)) ELSE p END), '')")
    commas = f"list_transform(string_split_regex({masked}, ',[{WS}]*'), lambda p: {sql_strip('replace(p, chr(1), chr(44))')})"
    marks = "'-•*'"
    bullets = f"list_transform(string_split({block}, chr(10)), lambda l: {sql_strip(f'ltrim({sql_strip(chr(108))}, {marks})')})"
    bulleted = f"contains({block}, chr(10)) AND regexp_matches({block}, '(?m)^[{WS}]*[-•*]')"
    return f"list_filter(CASE WHEN {bulleted} THEN {bullets} ELSE {commas} END, lambda p: length(p) > 1 AND length(p) < 120)"


def sql_first_30(items: str, low: str) -> str:
    return f"list_filter({items}, lambda p, i: list_position({low}, lower(p)) = i)[1:30]"


def sql_lower(items: str) -> str:
    return f"list_transform({items}, lambda p: lower(p))"


_STEP_HEAD = f"(^|\\n)[{WS}]*(?:Step[{WS}]*)?[\\p{{Nd}}]+[.):{WS}]+"


def sql_steps(b: str) -> str:
    steps = (f"list_filter(list_transform(string_split(regexp_replace({b}, '{_STEP_HEAD}', chr(1), 'g'), chr(1))[2:], "
             f"lambda s: replace({sql_strip('s')}, chr(10), ' ')), lambda s: length(s) > 15)")
    broken = f"regexp_replace(replace({b}, chr(10), ' '), '([.!?])[{WS}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    sentences = f"list_filter(list_transform(string_split({broken}, chr(1)), lambda s: {sql_strip('s')}), lambda s: length(s) > 20)"
    return f"(CASE WHEN regexp_matches({b}, '{_STEP_HEAD}(?s:.)') THEN {steps} ELSE {sentences} END)[1:15]"


@query(f"""
WITH x AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN array_to_string(list_transform({sql_words("text")},
                  lambda w: '• ' || w), chr(10)) ELSE 'one (two, three), four,' || text END AS b FROM documents),
y AS (SELECT doc_id, {sql_display_items("b")} AS items FROM x),
z AS (SELECT doc_id, items, {sql_lower("items")} AS low FROM y)
SELECT doc_id, array_to_string({sql_first_30("items", "low")}, '|') AS items FROM z""")
def split_items_display(spark: SparkSession, sf: str) -> DataFrame:
    commas = F.concat(F.lit("one (two, three), four,"), F.col("text"))
    bullets = F.array_join(F.transform(words(F.col("text")), lambda w: F.concat(F.lit("• "), w)), "\n")
    block = F.when(F.col("lang") == "fr", bullets).otherwise(commas)
    return texts(spark, sf, "documents").select(
        "doc_id", F.array_join(parse.split_items_display(block), "|").alias("items"))


_NUMBERED = "list_transform(string_split(text, chr(10)), lambda l, i: i || CASE WHEN i % 2 = 0 THEN '. ' ELSE ') ' END || l)"


@query(f"""
WITH x AS (SELECT doc_id, CASE WHEN lang = 'en' THEN array_to_string({_NUMBERED}, chr(10)) ELSE text END AS b FROM documents)
SELECT doc_id, array_to_string({sql_steps("b")}, '|') AS steps FROM x""")
def split_steps(spark: SparkSession, sf: str) -> DataFrame:
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda l, i: F.concat(
        (i + 1).cast("string"), F.when((i + 1) % 2 == 0, ". ").otherwise(") "), l)), "\n")
    block = F.when(F.col("lang") == "en", numbered).otherwise(F.col("text"))
    return texts(spark, sf, "documents").select("doc_id", F.array_join(parse.split_steps(block), "|").alias("steps"))


def sql_title(t: str) -> str:
    bold = sql_strip(f"regexp_extract({t}, '(?m)^[*][*](.+?)[*][*]', 1)")
    return f"""CASE WHEN regexp_matches({t}, '(?m)^[*][*](.+?)[*][*]') AND NOT regexp_matches(lower({bold}), 'ingredient|instruction|step|method')
       THEN {bold} WHEN len({sql_lines(t)}) > 0 THEN {sql_strip(f"ltrim(({sql_lines(t)})[1], '*#')")} ELSE 'Indian Recipe' END"""


def sql_display(source: str, key: str, text: str) -> str:
    """CTE ``shown(key, title, items, steps)`` of the display parse of texts
    that have both headers."""
    def block(head: str, plain: str, end: str, plain_end: str) -> str:
        bold = f"regexp_replace(regexp_extract(t, '(?is){head}(.*)$', 1), '(?is){end}.*$', '')"
        loose = f"regexp_replace(regexp_extract(t, '(?is){plain}(.*)$', 1), '(?is){plain_end}.*$', '')"
        return sql_strip(f"CASE WHEN regexp_matches(t, '(?is){head}') THEN {bold} ELSE {loose} END")

    items = block(rf"\*\*Ingredients[:{WS}]*\*\*", rf"Ingredients[:{WS}]+", r"\*\*(?:Instructions|Method|Steps)",
                  "(?:Instructions|Method|Steps)")
    steps = block(rf"\*\*(?:Instructions|Method|Steps)[:{WS}]*\*\*", rf"(?:Instructions|Method|Steps)[:{WS}]+",
                  r"\*\*(?:Tips|Serving|Notes|Chef)", "(?:Tips|Serving|Notes)")
    return f"""
shown_src AS (SELECT {key} AS key, {sql_strip(text)} AS t FROM {source}),
shown_blocks AS (SELECT key, t, {items} AS ib, {steps} AS sb FROM shown_src),
shown_all AS (SELECT key, t, sb, {sql_display_items("ib")} AS every FROM shown_blocks),
shown_low AS (SELECT *, {sql_lower("every")} AS low FROM shown_all),
shown AS (SELECT key, {sql_title("t")} AS title, array_to_string({sql_first_30("every", "low")}, '|') AS items,
                 array_to_string({sql_steps("sb")}, '|') AS steps FROM shown_low)"""


@query(f"""
WITH {DOC_RECIPES_SQL}, x AS (SELECT doc_id, {sql_strip("recipe")} AS t FROM doc_recipes)
SELECT doc_id, {sql_title("t")} AS title FROM x""")
def extract_title(spark: SparkSession, sf: str) -> DataFrame:
    return doc_recipes(spark, sf).select("doc_id", parse.display_title(F.col("recipe")).alias("title"))


def sql_word(options: list[str]) -> str:
    """The first of the words in ``t``, between characters that are no letters or digits."""
    edge = r"[^\p{L}\p{N}_]"
    return f"nullif(regexp_extract(t, '(?i)(?:^|{edge})({'|'.join(options)})(?:{edge}|$)', 1), '')"


_NOTED_SQL = f"""
noted AS (SELECT doc_id, recipe || chr(10) || chr(10) || '**Notes:**' || chr(10) || 'A ' || CASE lang WHEN 'en' THEN 'vegan' WHEN 'fr'
  THEN 'Non-Vegetarian' WHEN 'de' THEN 'Jain' ELSE 'plain' END || ' ' || CASE doc_id % 3 WHEN 0 THEN 'north indian' WHEN 1 THEN 'Goan'
  ELSE 'homely' END || CASE WHEN doc_id % 2 = 0 THEN ' side dish' ELSE ' meal' END || '. Total Time: ' || (doc_id % 95 + 1)
  || CASE WHEN doc_id % 5 = 0 THEN ' hours' ELSE ' mins' END || '. Spice level: ' || (doc_id % 10) AS noted FROM doc_recipes)"""


@query(f"""
WITH {DOC_RECIPES_SQL}, {_NOTED_SQL}, {sql_display("noted", "doc_id", "noted")},
m AS (SELECT doc_id, {sql_strip("noted")} AS t FROM noted),
w AS (SELECT doc_id, {sql_word(REGIONS)} AS region, lower({sql_word(DIETS)}) AS d, {sql_word(COURSES)} AS course FROM m)
SELECT key AS doc_id, title, items, steps, region, CASE WHEN contains(d, 'vegan') THEN 'Vegan' WHEN contains(d, 'jain') THEN 'Jain'
       WHEN contains(d, 'non') THEN 'Non-Vegetarian' WHEN d IS NOT NULL THEN 'Vegetarian' END AS diet,
       CASE WHEN key % 5 = 0 THEN 60 ELSE 1 END * (key % 95 + 1) AS time_mins, least(5, key % 10) AS spice_level, course
FROM shown JOIN w ON w.doc_id = key""")
def parse_display(spark: SparkSession, sf: str) -> DataFrame:
    """Whole recipes with a line of notes, which names what the metadata are read from."""
    i, lang = F.col("doc_id"), F.col("lang")
    diet = F.when(lang == "en", "vegan").when(lang == "fr", "Non-Vegetarian").when(lang == "de", "Jain").otherwise("plain")
    region = F.when(i % 3 == 0, "north indian").when(i % 3 == 1, "Goan").otherwise("homely")
    notes = F.concat(
        F.lit("A "), diet, F.lit(" "), region, F.when(i % 2 == 0, " side dish").otherwise(" meal"), F.lit(". Total Time: "),
        (i % 95 + 1).cast("string"), F.when(i % 5 == 0, " hours").otherwise(" mins"), F.lit(". Spice level: "), (i % 10).cast("string"))
    noted = doc_recipes(spark, sf).withColumn("recipe", F.concat("recipe", F.lit("\n\n**Notes:**\n"), notes))
    shown = parse.parse_display(noted, "recipe", ["doc_id"])
    return shown.select("doc_id", F.col("name").alias("title"), F.array_join("ingredients", "|").alias("items"),
                        F.array_join("steps", "|").alias("steps"), "metadata.*")


_META_TEXT = """'A ' || CASE p_type WHEN 'PROMO' THEN 'vegan' WHEN 'SMALL' THEN 'Non-Vegetarian' WHEN 'LARGE' THEN 'Jain'
  WHEN 'MEDIUM' THEN 'Diabetic' ELSE 'plain' END || ' ' || CASE WHEN p_size < 10 THEN 'north indian' WHEN p_size < 20 THEN 'Goan'
  ELSE p_name END || CASE WHEN p_size < 25 THEN ' side dish' ELSE ' thing' END || '. Total Time: ' || p_size ||
  CASE WHEN p_size < 15 THEN ' hours' WHEN p_size < 30 THEN ' to 90 mins' WHEN p_size < 40 THEN ' hrs' ELSE ' days' END ||
  '. Spice level: ' || (p_size % 10)"""


@query(f"""
WITH x AS (SELECT *, {_META_TEXT} AS t FROM part)
SELECT p_partkey, nullif(regexp_extract(t, '(?i)\\b({'|'.join(REGIONS)})\\b', 1), '') AS region,
       CASE p_type WHEN 'PROMO' THEN 'Vegan' WHEN 'SMALL' THEN 'Non-Vegetarian' WHEN 'LARGE' THEN 'Jain'
                   WHEN 'MEDIUM' THEN 'Vegetarian' END AS diet,
       CASE WHEN p_size < 15 THEN p_size * 60 WHEN p_size < 40 THEN p_size END AS time_mins,
       least(5, p_size % 10) AS spice_level,
       nullif(regexp_extract(t, '(?i)\\b({'|'.join(COURSES)})\\b', 1), '') AS course FROM x""")
def extract_metadata(spark: SparkSession, sf: str) -> DataFrame:
    t, s = F.col("p_type"), F.col("p_size")
    diet = (F.when(t == "PROMO", "vegan").when(t == "SMALL", "Non-Vegetarian").when(t == "LARGE", "Jain")
            .when(t == "MEDIUM", "Diabetic").otherwise("plain"))
    region = F.when(s < 10, "north indian").when(s < 20, "Goan").otherwise(F.col("p_name"))
    unit = F.when(s < 15, " hours").when(s < 30, " to 90 mins").when(s < 40, " hrs").otherwise(" days")
    text = F.concat(F.lit("A "), diet, F.lit(" "), region, F.when(s < 25, " side dish").otherwise(" thing"),
                    F.lit(". Total Time: "), s.cast("string"), unit, F.lit(". Spice level: "), (s % 10).cast("string"))
    return table(spark, sf, "part").select("p_partkey", parse.metadata(text).alias("m")).select("p_partkey", "m.*")


# ---- items --------------------------------------------------------------

_UNIT_SQL = """CASE l_linenumber WHEN 1 THEN ' cup ' WHEN 2 THEN 'g ' WHEN 3 THEN ' tbsps ' WHEN 4 THEN '/2 ½ '
               WHEN 5 THEN '-3 large ' ELSE ' unknown ' END"""


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as item texts: quantity, unit, part name."""
    n = F.col("l_linenumber")
    unit = (F.when(n == 1, " cup ").when(n == 2, "g ").when(n == 3, " tbsps ").when(n == 4, "/2 ½ ")
            .when(n == 5, "-3 large ").otherwise(" unknown "))
    lines = texts(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus",
        F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), unit, F.upper("p_name")).alias("item"))


LINE_ITEMS_SQL = f"""
line_items AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus,
       ' ' || CAST(l_quantity AS INT) || {_UNIT_SQL} || upper(p_name) AS item,
       CASE WHEN l_linenumber > 5 THEN 'unknown ' || p_name WHEN l_linenumber <> 4 THEN p_name
            ELSE regexp_replace(p_name, '^(small|medium|large) ', '') END AS plain
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(f"WITH {LINE_ITEMS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, item, plain FROM line_items")
def normalise_items(spark: SparkSession, sf: str) -> DataFrame:
    return line_items(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "item", parse.normalise_item(F.col("item")).alias("plain"))


@query(f"""
WITH {LINE_ITEMS_SQL} SELECT plain AS item, count(*) AS n FROM line_items GROUP BY plain ORDER BY n DESC, item LIMIT 200""")
def item_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return parse.item_vocabulary(line_items(spark, sf), F.array("item"))


@query("""
SELECT p_partkey, p_name || '|' || p_type || '||' || p_brand AS items FROM part""")
def legacy_clean_items(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" (cut, or whole) , "), "p_type", F.lit(", , "), "p_brand", F.lit("(x)"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(parse.legacy_items(raw), "|").alias("items"))


def _dialect_text(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf, "documents")
    lines, item_words = F.split("text", "\n"), words(F.col("text"))

    def block(items: Column, body: Column) -> Column:
        return F.concat(F.lit("Sure!\nIngredients Used:\n"), F.array_join(items, "\n"),
                        F.lit("\n\nInstructions:\n"), F.array_join(body, "\n"))

    dashed = block(F.transform(item_words, lambda w: F.concat(F.lit("  - "), w)),
                   F.transform(lines, lambda l: F.concat(F.lit("- "), l)))
    starred = block(F.transform(item_words, lambda w: F.concat(F.lit("* "), w, F.lit(" (fresh)"))),
                    F.transform(lines, lambda l, i: F.concat((i + 1).cast("string"), F.lit(". "), l)))
    lang = F.col("lang")
    dialect = F.when(lang == "en", "dash").when(lang == "fr", "star").otherwise("marker")
    return d.select("doc_id", dialect.alias("dialect"), F.when(lang.isin("en", "de"), dashed)
                    .when(lang == "fr", starred).otherwise(F.concat(F.lit("Ingredients Used:\n"), "text")).alias("t"))


_DASHED_BODY = f"list_transform({sql_lines('text')}, lambda l: l)"
_MARKER_ITEM = f"regexp_replace({sql_strip(f'''trim(w, '- ')''')}, '[{WS}]*\\([^\\n]*?\\)', '', 'g')"
_MARKER_LINE = sql_strip("trim('- ' || l, '- ')")


@query(f"""
SELECT doc_id, CASE lang WHEN 'en' THEN 'dash' WHEN 'fr' THEN 'star' ELSE 'marker' END AS dialect,
       array_to_string(CASE lang WHEN 'en' THEN {sql_words("text")}
         WHEN 'fr' THEN list_transform({sql_words("text")}, lambda w: {sql_strip("split_part(w, '(', 1)")})
         WHEN 'de' THEN list_transform({sql_words("text")}, lambda w: {_MARKER_ITEM}) END, '|') AS items,
       array_to_string(CASE lang WHEN 'en' THEN {_DASHED_BODY} WHEN 'fr' THEN {_DASHED_BODY}
         WHEN 'de' THEN list_transform(string_split(text, chr(10)), lambda l: {_MARKER_LINE}) END, '|') AS body
FROM documents""")
def parse_dialects(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse.parse_dialects(_dialect_text(spark, sf), "t", "dialect", ["doc_id"])
    return parsed.select("doc_id", "dialect", F.array_join("items", "|").alias("items"), F.array_join("body", "|").alias("body"))


@query(f"""
SELECT conv_id, turn, CASE WHEN turn > 2 THEN 'adaptation' ELSE 'generation' END AS inference_type,
       substr('inference:' || CASE WHEN turn > 2 THEN 'adapt:' ELSE 'dish:' END || text, 1, 50) AS run_name,
       substr(CASE WHEN turn > 2 THEN 'adapt:' ELSE 'dish:' END || text, 1, 100) AS tag,
       length(text) AS response_length_chars, len({sql_tokens("text")}) AS response_length_words FROM conversations""")
def trace_measures(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.concat(F.when(F.col("turn") > 2, "adapt:").otherwise("dish:"), F.col("text"))
    measures = parse.trace_measures(F.col("text"), tag)
    return table(spark, sf, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in measures.items()])


# ---- lists, lookups, choices --------------------------------------------

@query("""
WITH x AS (SELECT p_partkey, list_concat([p_type, p_name], [p_brand, p_type],
                  CASE WHEN p_size > 20 THEN ['extra', p_name, 'Extra'] ELSE [] END) AS items FROM part)
SELECT p_partkey, array_to_string(list_filter(items, lambda t, i: list_position(items, t) = i), '|') AS items FROM x""")
def list_union(spark: SparkSession, sf: str) -> DataFrame:
    groups = F.array(F.array("p_type", "p_name"), F.lit(None).cast("array<string>"), F.array("p_brand", "p_type"))
    custom = F.when(F.col("p_size") > 20, F.concat(F.lit(" extra, ,"), "p_name", F.lit(" , Extra")))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(session.list_union(groups, custom), "|").alias("items"))


@query("""
WITH f AS (SELECT p_brand AS category, unnest([p_name, p_type]) AS item FROM part)
SELECT category, item, count(*) OVER (PARTITION BY item) AS n_uses FROM f""")
def category_flatten(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("category"), F.array("p_name", "p_type").alias("items"))
    return session.category_flatten(parts, "category", "items")


_TITLED = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(f"""
SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'RING' WHEN contains(p_name, 'blue') THEN 'blue' END AS matched,
       CASE WHEN contains(p_name, 'ring') THEN 'all about rings' WHEN contains(p_name, 'blue') THEN 'all in blue'
            WHEN p_size > 10 THEN 'Demo of ' || {_TITLED} || '; more ' || {_TITLED} ELSE 'Demo of Indian Dish; more Indian Dish' END AS answer
FROM part""")
def keyword_lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.when(F.col("p_size") > 10, F.concat(F.lit("Generate a RECIPE for "), F.lower("p_name")))
    rows = table(spark, sf, "part").select("p_partkey", F.coalesce(asked, F.col("p_name")).alias("message"))
    found = session.keyword_lookup(rows, "message", [("ring", "all about rings"), ("blue", "all in blue")],
                                   "Demo of {dish}; more {dish}", "{dish}", ["p_partkey"])
    return found.withColumn("matched", F.when(F.col("matched") == "ring", "RING").otherwise(F.col("matched")))


_SETS_SQL = "[" + ", ".join(_quoted("|".join(s)) for s in SEED_SETS) + "]"


@query(f"""
WITH x AS (SELECT o_orderkey, CAST(CAST('0x' || substr(md5('7-' || o_orderkey), 1, 8) AS BIGINT) % {len(SEED_SETS)} AS INT) AS choice FROM orders)
SELECT o_orderkey, choice, ({_SETS_SQL})[choice + 1] AS items FROM x""")
def seeded_choice(spark: SparkSession, sf: str) -> DataFrame:
    picked = session.seeded_choice(table(spark, sf, "orders"), "o_orderkey", SEED_SETS, 7, ["o_orderkey"])
    return picked.withColumn("items", F.array_join("items", "|"))


@query("""
WITH used AS (SELECT unnest([p_name, p_type]) AS item FROM part)
SELECT item, count(*) AS n_uses FROM used WHERE item NOT IN (SELECT p_name FROM part WHERE p_size > 48) GROUP BY item""")
def dictionary_audit(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    return session.dictionary_audit(parts, F.array("p_name", "p_type"), parts.where(F.col("p_size") > 48), "p_name")


@query(f"""
WITH x AS (SELECT doc_id, len({sql_lines("text")}) AS n, unnest({sql_lines("text")}) AS step,
                  generate_subscripts({sql_lines("text")}, 1) - 1 AS i FROM documents)
SELECT doc_id, i AS step_idx, n AS n_steps, step, CAST(floor((i + 1) / n * 100) AS INT) AS progress_pct,
       least(i + 1, n - 1) AS next_idx, greatest(i - 1, 0) AS prev_idx FROM x""")
def step_cursor(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.filter(F.transform(F.split("text", "\n"), wstrip), lambda s: s != "")
    return session.step_cursor(texts(spark, sf, "documents").withColumn("steps", steps), "steps", ["doc_id"])


@query(f"""
SELECT doc_id, coalesce(({sql_lines("text")})[n_chars % 5 + 1], ({sql_lines("text")})[1]) AS step FROM documents""")
def step_at(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.filter(F.transform(F.split("text", "\n"), wstrip), lambda s: s != "")
    docs = texts(spark, sf, "documents").withColumn("steps", steps)
    return docs.select("doc_id", session.step_at(F.col("steps"), (F.col("n_chars") % 5).cast("int")).alias("step"))
