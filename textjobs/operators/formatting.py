"""Prompts, responses, chat messages and completion spans."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textjobs.functions.fixed import (
    ADAPTATION_FRAME, ADAPTATIONS, ANY_DIET, ANY_REGION, ANY_TIME, ASSISTANT_OPENER, BEGIN_TEXT,
    CUTOFF_LINE, DEFAULT_CHAT_DATE, DEFAULT_DESCRIPTOR, DEFAULT_ITEMS, END_TURN, HEADER_CLOSE,
    HEADER_OPEN, SYSTEM_PROMPT,
)
from textjobs.functions.text import article, as_col, not_blank, wstrip, wstrip_long
from textjobs.operators.ordered import carry_forward, row_places


def request_text(name: Column, cuisine: Column, diet: Column, course: Column) -> Column:
    """``Generate a <diet> <cuisine> <course> recipe for <name>``; blank parts
    are left out and the article follows the first letter."""
    descriptor = F.concat_ws(" ", F.when(not_blank(diet), wstrip(diet)), wstrip(cuisine))
    return F.concat_ws(
        " ", F.concat(F.lit("Generate "), article(descriptor)), descriptor,
        F.when(not_blank(course), wstrip(F.lower(course))),
        F.concat(F.lit("recipe for "), wstrip(name)),
    )


def response_text(name: Column, items: Column, body: Column) -> Column:
    """Bold title, three line feeds, then the two bold-headed sections."""
    return F.concat(
        F.lit("**"), wstrip(name), F.lit("**\n\n\n**Ingredients:**\n"), wstrip_long(items),
        F.lit("\n\n**Instructions:**\n"), wstrip_long(body),
    )


def build_pairs(df: DataFrame, keep: list[str] = [], name: str = "TranslatedRecipeName",
                items: str = "TranslatedIngredients", body: str = "TranslatedInstructions",
                cuisine: str = "Cuisine", diet: str = "Diet", course: str = "Course",
                system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Prompt and response of every row."""
    return df.select(
        *keep, F.lit(system_prompt).alias("system_prompt"),
        request_text(F.col(name), F.col(cuisine), F.col(diet), F.col(course)).alias("user_message"),
        response_text(F.col(name), F.col(items), F.col(body)).alias("assistant_response"),
        F.col(cuisine).alias("cuisine"), F.col(diet).alias("diet"), F.col(course).alias("course"),
    )


def form_request_text(name: Column, items: Column, diet: Column, region: Column, time: Column) -> Column:
    """Request of an input form: by dish name, or else by item list with an
    optional time limit."""
    diet_part = F.when((diet != "") & (diet != ANY_DIET), diet)
    region_part = F.when((region != "") & (region != ANY_REGION), region)
    chosen = F.concat_ws(" ", diet_part, region_part)
    named = F.when(chosen == "", DEFAULT_DESCRIPTOR).otherwise(chosen)
    by_name = F.concat(
        F.lit("Generate "), article(named), F.lit(" "), named, F.lit(" recipe for "), wstrip(name))
    described = F.concat_ws(" ", diet_part, region_part, F.lit("recipe"))
    minutes = wstrip(F.replace(F.replace(time, F.lit("Under "), F.lit("")), F.lit(" min"), F.lit("")))
    limit = F.when(
        (time != "") & (time != ANY_TIME), F.concat(F.lit(" ready in under "), minutes, F.lit(" minutes")))
    listed = F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, ", ")).otherwise(DEFAULT_ITEMS)
    by_items = F.concat(
        F.lit("Generate "), article(described), F.lit(" "), described, F.coalesce(limit, F.lit("")),
        F.lit(" using these ingredients: "), listed)
    return F.when(not_blank(name), by_name).otherwise(by_items)


def adaptation_text(text: Column, modification: Column) -> Column:
    before, middle, after = ADAPTATION_FRAME.split("%s")
    return F.concat(F.lit(before), text, F.lit(middle), modification, F.lit(after))


def build_adaptations(df: DataFrame, text: str, keep: list[str],
                      presets: list[tuple[str, str]] = ADAPTATIONS) -> DataFrame:
    """Every non-blank text with each preset modification, by a narrow explode."""
    options = F.array(*[F.struct(F.lit(k).alias("preset"), F.lit(v).alias("change")) for k, v in presets])
    wide = df.where(not_blank(text)).select(*keep, text, F.explode(options).alias("o"))
    return wide.select(
        *keep, F.col("o.preset").alias("preset"),
        adaptation_text(F.col(text), F.col("o.change")).alias("user_message"),
    )


def fill_templates(df: DataFrame, slot: str, templates: list[str], keep: list[str], marker: str) -> DataFrame:
    """Each row in each template, numbered from 1, with the slot filled in."""
    options = F.array(*[F.lit(t) for t in templates])
    wide = df.select(*keep, F.col(slot).alias("_slot"), F.posexplode(options).alias("_i", "_t"))
    return wide.select(
        *keep, (F.col("_i") + 1).alias("prompt_number"),
        F.replace("_t", F.lit(marker), F.col("_slot")).alias("prompt"),
    )


def messages(system: Column | str, user: Column | str, assistant: Column | str | None = None) -> Column:
    """Role and content structs of one training example."""
    turns = [("system", system), ("user", user)] + ([("assistant", assistant)] if assistant is not None else [])
    return F.array(*[
        F.struct(F.lit(role).alias("role"), as_col(text).alias("content")) for role, text in turns
    ])


def _chat_block(role: Column, content: Column) -> Column:
    return F.concat(F.lit(HEADER_OPEN), role, F.lit(HEADER_CLOSE + "\n\n"), content, F.lit(END_TURN))


def render_chat(msgs: Column, opener: bool = False, date: str = DEFAULT_CHAT_DATE) -> Column:
    """Chat text of a message array: the system block with its date lines is
    always first, contents are stripped, an opener may ask for an answer."""
    first_is_system = F.get(msgs, F.lit(0))["role"] == "system"
    system = F.when(first_is_system, wstrip(F.get(msgs, F.lit(0))["content"])).otherwise("")
    rest = F.when(first_is_system, F.slice(msgs, F.lit(2), F.size(msgs))).otherwise(msgs)

    head = _chat_block(F.lit("system"), F.concat(F.lit(f"{CUTOFF_LINE}Today Date: {date}\n\n"), system))
    body = F.array_join(F.transform(rest, lambda m: _chat_block(m["role"], wstrip(m["content"]))), "")
    return F.concat(F.lit(BEGIN_TEXT), head, body, F.lit(ASSISTANT_OPENER if opener else ""))


def completion_span(df: DataFrame, text: str) -> DataFrame:
    """Start and length (characters, from zero) of the text after the last
    assistant header; rows without a header have no target."""
    found = F.contains(F.col(text), F.lit(ASSISTANT_OPENER))
    target = F.when(found, F.substring_index(F.col(text), ASSISTANT_OPENER, -1))
    return df.withColumns({
        "target_start": F.length(text) - F.length(target), "target_length": F.length(target),
        "skipped": ~found,
    })


def turn_messages(turns: DataFrame, conversation: str, order: list[str], role: str, text: str) -> DataFrame:
    """Every turn with the training example that ends in it.

    Adds ``system`` (the latest system text up to the turn, null when there is
    none), ``before_role`` and ``before`` (the turn in front of it, null for
    the first) and ``messages``: the system text in force; for an answer the
    user's turn in front of it; the turn itself.  So a system turn is a message
    of its own, a user turn an open chat and an answer a whole exchange; no turn
    is left out.  A null role is an empty one; a null text is an empty content,
    and as a system text it leaves the one before in force.  A conversation of
    any length is cut into segments by counts.
    """
    is_system = F.coalesce(F.col(role) == "system", F.lit(False))
    turn = F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    carried = carry_forward(turns, [conversation], None, [*order, role], [F.when(is_system, F.col(text)), turn],
                            ["_system", "_before"], include_current=False)
    named = carried.withColumns({
        "system": F.when(is_system, F.coalesce(text, "_system")).otherwise(F.col("_system")),
        "before_role": F.col("_before.role"), "before": F.col("_before.content")})
    asked = (F.col(role) == "assistant") & (F.col("_before.role") == "user")
    in_force = F.struct(F.lit("system").alias("role"), F.col("system").alias("content"))
    parts = F.array_compact(F.array(
        F.when(F.col("system").isNotNull() & ~is_system, in_force), F.when(asked, F.col("_before")), turn))
    return named.withColumn("messages", parts).drop("_system", "_before")


def conversation_fragments(turns: DataFrame, conversation: str, order: list[str], role: str, text: str, size: int = 64,
                           date: str = DEFAULT_CHAT_DATE) -> DataFrame:
    """Every conversation as fragments of ``size`` messages in order, so a
    conversation of any length is a matter of rows, never of one row.

    A row has the conversation, ``fragment`` and ``first_message`` from zero,
    ``messages`` (role and content as they are) and ``chat``: the text of its
    part of the chat.  The chats of a conversation's fragments, joined in order,
    are what ``render_chat`` gives for all its messages: fragment 0 starts with
    the system block, which holds the first message if that is the system's.
    No turn is left out: a null role is an empty one, a null text an empty
    content.  Turns with equal places in ``order`` follow by role and text;
    null is a conversation like others.
    """
    rows = turns.select(
        F.col(conversation).alias("_c"), F.struct(*order).alias("_o"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    placed = row_places(rows, ["_c"], ["_o"], "_at", ("role", "content"))
    message = F.struct(F.col("_at").alias("at"), "role", "content")
    grouped = placed.groupBy("_c", F.floor(F.col("_at") / size).alias("fragment")).agg(
        F.array_sort(F.collect_list(message)).alias("_m"))
    msgs = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    shown = grouped.select(F.col("_c").alias(conversation), "fragment", (F.col("fragment") * size).alias("first_message"), msgs.alias("messages"))
    chat = F.when(F.col("fragment") == 0, render_chat(F.col("messages"), date=date)).otherwise(
        F.array_join(F.transform("messages", lambda m: _chat_block(m["role"], wstrip(m["content"]))), ""))
    return shown.withColumn("chat", chat)


def whole_conversations(fragments: DataFrame, conversation: str) -> DataFrame:
    """One row per conversation, for callers who know theirs to be short."""
    parts = F.array_sort(F.collect_list(F.struct("fragment", "messages", "chat")))
    return fragments.groupBy(conversation).agg(parts.alias("_p")).select(
        conversation, F.flatten(F.transform("_p", lambda p: p["messages"])).alias("messages"),
        F.array_join(F.transform("_p", lambda p: p["chat"]), "").alias("chat"))
