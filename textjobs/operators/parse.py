"""Parsing of sectioned texts into title, item list, body and metadata.

A text is split in front of its header lines and each part is known by its
first line.  That is linear in the text, needs no shuffle and no fold over
lines, and every step is a JVM expression.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textjobs.functions.fixed import COURSES, DEFAULT_TITLE, DIETS, REGIONS, UNITS
from textjobs.functions.text import HS, WS, split_trim, word_count, wstrip

MASK = "\x02"  # stands for a comma that does not split
_LINE = "(?im-s)(?d)"  # per-line anchors, line feed is the only line end

# Headers, list markers and numbering that the formats use.
BEFORE_HEADER = rf"{_LINE}^(?=[{HS}]*\*\*[^\n]*(?:ingredient|instruction))"
BEFORE_DIALECT_HEADER = rf"(?dm)^(?=[{HS}]*(?:Ingredients Used:|Instructions:)[{HS}]*$)"
BOLD_LINE = rf"{_LINE}^[{HS}]*\*\*(?:\*?|[^\n]*\*\*)[{HS}]*$"
BOLD_TITLE = rf"{_LINE}^[{HS}]*(\*\*[^\n]+\*\*)[{HS}]*$"
LOOSE_ITEMS = (
    rf"(?is)(?:#{{1,3}}[{WS}]*)?[*_]*ingredients?[*_]*:?[*_]*[{WS}]*\n(.*?)"
    rf"(?=\n[{WS}]*(?:#{{1,3}}[{WS}]*)?[*_]*instructions?|\z)"
)
LOOSE_BODY = rf"(?is)(?:#{{1,3}}[{WS}]*)?[*_]*instructions?[*_]*:?[*_]*[{WS}]*\n(.*)\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the
    body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(text: Column, pattern: str) -> Column:
    """First group of the first match, null where there is no match.  Only an
    empty result needs a second look at the text."""
    return let(F.regexp_extract(text, pattern, 1), lambda found: F.when(
        (found != "") | F.regexp_like(text, F.lit(pattern)), found))


def split_items(raw: Column) -> Column:
    """Items of a block: several lines are bullet lines that may hold comma
    lists; one line is a comma list."""
    def items(lines: Column) -> Column:
        many = F.size(lines) > 1
        marked = lambda l: F.startswith(l, F.lit("-")) | F.startswith(l, F.lit("*")) | F.startswith(l, F.lit("•"))
        bare = F.transform(lines, lambda l: F.when(many & marked(l), wstrip(F.substr(l, F.lit(2)))).otherwise(l))
        one = lambda l: F.when(l == "", F.array().cast("array<string>")).otherwise(F.array(l))
        return F.flatten(F.transform(bare, lambda l: F.when(F.contains(l, F.lit(",")), split_trim(l, ",")).otherwise(one(l))))

    return let(split_trim(raw, "\n"), items)


def _nonblank_lines(text: Column) -> Column:
    return F.array_join(split_trim(text, "\n"), "\n")


def strict_title(text: Column) -> Column:
    """First bold line that does not name a section."""
    bold = F.regexp_extract_all(text, F.lit(BOLD_TITLE), F.lit(1))
    names = F.filter(
        F.transform(bold, lambda l: wstrip(F.btrim(l, F.lit("*")))),
        lambda n: ~F.contains(F.lower(n), F.lit("ingredient")) & ~F.contains(F.lower(n), F.lit("instruction")),
    )
    return F.coalesce(F.get(names, F.lit(0)), F.lit(""))


def _parts(text: Column, before: str, kind: Callable[[Column], Column]) -> Column:
    """Pieces between header lines: kind by the stripped first line (null for
    the text before any header) and the content after it."""
    return F.transform(F.split(text, before), lambda p: let(F.substring_index(p, "\n", 1), lambda head: F.struct(
        kind(wstrip(head)).alias("kind"), F.substr(p, F.length(head) + 2).alias("content"))))


def _strict_kind(head: Column) -> Column:
    bold, low = F.startswith(head, F.lit("**")), F.lower(head)
    return F.when(bold & F.contains(low, F.lit("ingredient")), "i").when(bold & F.contains(low, F.lit("instruction")), "b")


def _strict_parts(text: Column) -> Column:
    return _parts(text, BEFORE_HEADER, _strict_kind)


def _until_bold(content: Column) -> Column:
    """Item content up to another bold line, which ends the list."""
    return F.get(F.split(content, BOLD_LINE, 2), F.lit(0))


def _section(parts: Column, kind: str) -> Column:
    own = F.transform(F.filter(parts, lambda p: p["kind"] == kind), lambda p: p["content"])
    return _nonblank_lines(F.array_join(F.transform(own, _until_bold) if kind == "i" else own, "\n"))


def parse_sections(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds ``name``, ``ingredients`` and ``instructions`` (with a prefix).

    The strict form needs bold headers.  Where it finds no items or no body,
    a looser pattern over the whole text fills just that field.  Blank text
    gives empty fields.
    """
    out = df.withColumn("_t", F.coalesce(wstrip(text), F.lit("")))
    out = out.withColumn("_p", _strict_parts(F.col("_t")))
    out = out.withColumns({
        "_name": strict_title(F.col("_t")), "_i": split_items(_section(F.col("_p"), "i")),
        "_b": _section(F.col("_p"), "b"),
    })
    raw = F.coalesce(F.col(text), F.lit(""))
    loose_items = split_items(wstrip(F.regexp_extract(raw, LOOSE_ITEMS, 1)))
    loose_body = wstrip(F.regexp_extract(raw, LOOSE_BODY, 1))
    out = out.withColumns({
        prefix + "name": F.col("_name"),
        prefix + "ingredients": F.when(F.size("_i") > 0, F.col("_i"))
        .when(F.col("_t") == "", F.col("_i")).otherwise(loose_items),
        prefix + "instructions": F.when((F.col("_b") != "") | (F.col("_t") == ""), F.col("_b")).otherwise(loose_body),
    })
    return out.drop("_t", "_p", "_name", "_i", "_b")


def section_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per collected line of the strict form: section, number, line."""
    parts = df.select(*keep, F.posexplode(_strict_parts(wstrip(text))).alias("section_no", "_p"))
    kind, content = F.col("_p.kind"), F.col("_p.content")
    lines = F.when(kind == "i", _until_bold(content)).otherwise(content)
    return parts.where(kind.isNotNull()).select(
        *keep, F.when(kind == "i", "items").otherwise("body").alias("section"), "section_no",
        F.posexplode(split_trim(lines, "\n")).alias("line_no", "line"))


# ---- item normalisation -------------------------------------------------

# Characters of a leading quantity.
QUANTITY = rf"[\p{{Nd}}½¼¾{WS}/.\-]+"
QUANTITY_UNIT = rf"^{QUANTITY}({'|'.join(UNITS)})s?[{WS}]+"


def normalise_item(item: Column) -> Column:
    """Lower case without the leading quantity and unit."""
    plain = F.regexp_replace(wstrip(F.lower(item)), QUANTITY_UNIT, "")
    return wstrip(F.regexp_replace(plain, f"^{QUANTITY}", ""))


def normalise_items(items: Column) -> Column:
    """Set of the normalised items, blanks left out; repeats are normalised once."""
    return F.array_distinct(F.filter(F.transform(F.array_distinct(items), normalise_item), lambda t: t != ""))


def legacy_items(raw: Column) -> Column:
    """Comma parts after bracketed remarks are cut out; blank parts stay."""
    plain = F.regexp_replace(raw, rf"[{WS}]*\([^\n]*?\)[{WS}]*", "")
    return F.transform(F.split(plain, ","), wstrip)


# ---- display parse ------------------------------------------------------

def display_title(text: Column) -> Column:
    """First bold run at a line start unless it names a section; else the
    first line without leading marks; else a default."""
    def title(t: Column) -> Column:
        bold = let(first_match(t, r"(?dm)^\*\*(.+?)\*\*"), lambda found: F.when(
            ~F.regexp_like(F.lower(found), F.lit("ingredient|instruction|step|method")), wstrip(found)))
        line = F.regexp_extract(t, r"(?d)\A([^\n]+)", 1)  # the text is stripped, so its first line is not blank
        return F.coalesce(bold, F.when(line != "", wstrip(F.ltrim(wstrip(line), F.lit("*#")))), F.lit(DEFAULT_TITLE))

    return let(wstrip(text), title)


# Section headers of the display form.
SHOWN_ITEMS = rf"(?is)\*\*Ingredients[:{WS}]*\*\*(.*?)(?=\*\*(?:Instructions|Method|Steps)|\z)"
PLAIN_ITEMS = rf"(?is)Ingredients[:{WS}]+(.*?)(?=Instructions|Method|Steps|\z)"
SHOWN_STEPS = (
    rf"(?is)\*\*(?:Instructions|Method|Steps)[:{WS}]*\*\*(.*?)(?=\*\*(?:Tips|Serving|Notes|Chef)|\z)"
)
PLAIN_STEPS = rf"(?is)(?:Instructions|Method|Steps)[:{WS}]+(.*?)(?=Tips|Serving|Notes|\z)"
ITEMS_SPLIT = rf"(?i)\*\*Ingredients[:{WS}]*\*\*"
STEP_NUMBER = rf"[{WS}]*(?:Step[{WS}]*)?\p{{Nd}}+[.):{WS}]"
TOTAL_TIME = (
    rf"(?i)(?:total[{WS}]+time|prep[{WS}]+time|cooking[{WS}]+time|time[:{WS}]|ready[{WS}]+in)[:{WS}]+"
    rf"([0-9]+)[{WS}]*(?:to[{WS}]*[0-9]+[{WS}]*)?(?:minutes?|mins?|hours?|hrs?)"
)
SPICE_LEVEL = rf"[Ss]pice[{WS}]+[Ll]evel[:{WS}]+([0-9])"


def _comma_parts(block: Column) -> Column:
    """Parts between the commas that are not inside brackets.  A comma counts
    as inside when the next bracket after it closes; such commas are masked
    before the split, which keeps the work linear in the text, and stay so.  A
    text that holds the mask itself is split by looking ahead at every comma."""
    flat = F.replace(block, F.lit("\n"), F.lit(" "))
    pieces = F.regexp_extract_all(flat, F.lit(r"(?s)([^()]+[()]?|[()])"), F.lit(1))
    masked = F.transform(pieces, lambda p: F.when(
        F.endswith(p, F.lit(")")), F.replace(p, F.lit(","), F.lit(MASK))).otherwise(p))
    ahead = F.split(flat, r",(?![^(]*\))")
    return F.when(F.contains(block, F.lit(MASK)), ahead).otherwise(F.split(F.array_join(masked, ""), ","))


# Limits of the display parse; None lifts a limit, left_out() counts what it cost.
MOST_ITEMS, SHORTEST_ITEM, LONGEST_ITEM = 30, 2, 119
MOST_STEPS, SHORTEST_STEP, SHORTEST_SENTENCE = 15, 16, 21


def _most(found: Column, most: int | None) -> Column:
    return found if most is None else F.slice(found, 1, most)


def _long_enough(t: Column, shortest: int | None, longest: int | None = None) -> Column:
    fits = F.length(t) >= (1 if shortest is None else shortest)
    return fits if longest is None else fits & (F.length(t) <= longest)


def left_out(split: Callable[..., Column], block: Column, **limits: int | None) -> Column:
    """How many parts of a block the limits of ``split`` leave out."""
    names = [n for n in ("most", "shortest", "longest", "shortest_sentence") if n in split.__kwdefaults__]
    return F.size(split(block, **dict.fromkeys(names))) - F.size(split(block, **limits))


def split_items_display(block: Column, *, most: int | None = MOST_ITEMS, shortest: int | None = SHORTEST_ITEM,
                        longest: int | None = LONGEST_ITEM) -> Column:
    """Bulleted lines, or commas outside brackets; repeats (ignoring case) and
    items shorter or longer than the limits are left out; at most ``most``.

    The first parts of a long block mostly have ``most`` items among them; the
    others are looked at only where they have not."""
    def split(b: Column) -> Column:
        bulleted = F.contains(b, F.lit("\n")) & F.regexp_like(b, F.lit(rf"(?dm)^[{HS}]*[-•*]"))
        return F.struct(
            bulleted.alias("bulleted"), F.contains(b, F.lit(MASK)).alias("unmasked"),
            F.when(bulleted, F.split(b, "\n")).otherwise(_comma_parts(b)).alias("parts"))

    def cleaned(x: Column, parts: Column) -> Column:
        return F.filter(
            F.transform(parts, lambda p: F.when(x["bulleted"], wstrip(F.ltrim(wstrip(p), F.lit("-•*"))))
                        .when(x["unmasked"], wstrip(p)).otherwise(wstrip(F.replace(p, F.lit(MASK), F.lit(","))))),
            lambda t: _long_enough(t, shortest, longest))

    def first_of_each(found: Column) -> Column:
        folded = found["folded"]
        keys = _most(F.array_distinct(folded), most)
        return F.transform(keys, lambda k: F.get(found["items"], F.array_position(folded, k).cast("int") - 1))

    def items(x: Column, parts: Column) -> Column:
        return let(cleaned(x, parts), lambda kept: let(
            F.struct(kept.alias("items"), F.transform(kept, F.lower).alias("folded")), first_of_each))

    def shown(x: Column) -> Column:
        if most is None:
            return items(x, x["parts"])
        lead = 4 * most
        return let(items(x, F.slice(x["parts"], 1, lead)), lambda first: F.when(
            (F.size(first) >= most) | (F.size(x["parts"]) <= lead), first).otherwise(items(x, x["parts"])))

    return let(let(block, split), shown)


def display_items(text: Column) -> Column:
    def items(t: Column) -> Column:
        block = F.coalesce(first_match(t, SHOWN_ITEMS), first_match(t, PLAIN_ITEMS))
        return F.coalesce(split_items_display(wstrip(block)), F.array().cast("array<string>"))

    return let(wstrip(text), items)


def _sentences(text: Column, pattern: str, most: int | None = MOST_STEPS, shortest: int | None = SHORTEST_SENTENCE) -> Column:
    return _most(F.filter(F.transform(F.split(text, pattern), wstrip), lambda s: _long_enough(s, shortest)), most)


def split_steps(block: Column, *, most: int | None = MOST_STEPS, shortest: int | None = SHORTEST_STEP,
                shortest_sentence: int | None = SHORTEST_SENTENCE) -> Column:
    """Numbered steps, or sentences when nothing is numbered, of at least the
    given length; at most ``most``."""
    def steps(b: Column) -> Column:
        numbered = F.regexp_extract_all(
            b, F.lit(rf"(?s)(?:\A|\n){STEP_NUMBER}+(.+?)(?=(?:\n{STEP_NUMBER})|\z)"), F.lit(1))
        return let(numbered, lambda found: F.when(F.size(found) > 0, _most(F.filter(
            F.transform(found, lambda s: F.replace(wstrip(s), F.lit("\n"), F.lit(" "))),
            lambda s: _long_enough(s, shortest)), most,
        )).otherwise(_sentences(F.replace(b, F.lit("\n"), F.lit(" ")), rf"(?<=[.!?])[{WS}]+(?=[A-Z])", most, shortest_sentence)))

    return let(block, steps)


def display_steps(text: Column) -> Column:
    """Steps of the body; without a body, sentences after the item header."""
    def steps(t: Column) -> Column:
        rest = F.split(t, ITEMS_SPLIT)
        loose = let(rest, lambda pieces: _sentences(
            wstrip(F.coalesce(F.get(pieces, F.lit(1)), F.get(pieces, F.lit(0)))), rf"(?<=[.!?])[{WS}]+"))
        block = F.coalesce(first_match(t, SHOWN_STEPS), first_match(t, PLAIN_STEPS))
        return let(block, lambda b: F.when(b.isNotNull(), split_steps(wstrip(b))).otherwise(loose))

    return let(wstrip(text), steps)


def metadata(text: Column, hours_as_minutes: bool = False) -> Column:
    """Region, diet, time, spice level and course named in a text.

    A plain search for the words that a match can begin with decides whether a
    pattern is tried at all, and from where on.
    """
    def fields(x: Column) -> Column:
        t, low = x["text"], x["low"]

        def tail(heads: list[str]) -> Column:
            """The text from one character before the first of ``heads`` on, null without any."""
            first = F.least(F.lit(None).cast("int"), *[F.when(F.contains(low, F.lit(h)), F.locate(h, low)) for h in heads])
            return let(first, lambda at: F.when(at.isNotNull(), F.substr(
                t, F.when(x["aligned"], F.greatest(at - 1, F.lit(1))).otherwise(1))))

        def word(options: list[str], heads: list[str]) -> Column:
            edge = r"[\p{L}\p{N}_]"
            return found(heads, rf"(?i)(?<!{edge})({'|'.join(options)})(?!{edge})")

        def found(heads: list[str], pattern: str) -> Column:
            return let(tail(heads), lambda rest: F.regexp_substr(rest, F.lit(pattern)))  # Spark looks twice

        diet = let(F.lower(word(DIETS, ["veg", "non-veg", "non veg", "jain", "diabetic"])), lambda d: F.when(
            F.contains(d, F.lit("vegan")), "Vegan").when(F.contains(d, F.lit("jain")), "Jain")
            .when(F.contains(d, F.lit("non")), "Non-Vegetarian").when(d.isNotNull(), "Vegetarian"))

        def minutes(phrase: Column) -> Column:
            number = F.regexp_extract(phrase, "(?s)([0-9]+)", 1).try_cast("int")
            hours = F.contains(phrase, F.lit("hour"))
            if hours_as_minutes:  # also convert the short form, which parity leaves alone
                hours = hours | F.regexp_like(phrase, F.lit("hrs?$"))
            return F.when(hours, number * 60).otherwise(number)

        timed = F.contains(low, F.lit("time")) | F.contains(low, F.lit("ready"))
        time = F.when(timed, F.lower(found(["total", "prep", "cooking", "time", "ready"], TOTAL_TIME)))
        spice = F.regexp_extract(tail(["spice"]), SPICE_LEVEL, 1).try_cast("int")
        return F.struct(
            word(REGIONS, [r.lower() for r in REGIONS]).alias("region"), diet.alias("diet"),
            let(time, minutes).alias("time_mins"),
            let(spice, lambda n: F.when(n.isNotNull(), F.least(F.lit(5), n))).alias("spice_level"),
            word(COURSES, [c.lower() for c in COURSES]).alias("course"),
        )

    def lowered(t: Column) -> Column:
        low = F.lower(t)  # as long as the text, unless a letter has two in lower case
        return let(low, lambda l: F.struct(t.alias("text"), l.alias("low"), (F.length(l) == F.length(t)).alias("aligned")))

    return let(let(text, lowered), fields)


def parse_display(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Title, items, steps and metadata as shown to a reader."""
    c = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        *keep, display_title(c).alias("name"), display_items(c).alias("ingredients"),
        display_steps(c).alias("steps"), metadata(wstrip(c)).alias("metadata"), F.col(text).alias("raw"),
    )


# ---- three older output dialects ----------------------------------------

def parse_dialects(df: DataFrame, text: str, dialect: str, keep: list[str]) -> DataFrame:
    """Items and body lines of the dialects ``dash``, ``star`` and ``marker``.

    ``dash``: after the exact header lines only ``- `` lines count.  ``star``:
    items start with ``*`` and end at a bracket, body lines lose their number.
    ``marker``: the text between the two markers, line by line; without a
    marker both fields are null.
    """
    items_line, body_line = "Ingredients Used:", "Instructions:"
    parts = _parts(F.col(text), BEFORE_DIALECT_HEADER, lambda head: F.when(
        head == items_line, "i").when(head == body_line, "b"))

    def lines_of(part: Column) -> Column:
        return F.transform(F.split(part["content"], "\n"), wstrip)

    def section(kind: str) -> Column:
        return F.flatten(F.transform(F.filter(parts, lambda p: p["kind"] == kind), lines_of))

    def dash(kind: str) -> Column:
        kept = F.filter(section(kind), lambda l: F.startswith(l, F.lit("- ")))
        return F.transform(kept, lambda l: wstrip(F.substr(l, F.lit(3))))

    def is_star(line: Column) -> Column:
        return F.startswith(line, F.lit("*"))

    star_items = F.transform(
        F.filter(section("i"), is_star),
        lambda l: wstrip(F.get(F.split(F.substr(l, F.lit(2)), r"\("), F.lit(0))))

    def star_lines(ps: Column) -> Column:
        # once a body has begun, a later item header only claims the star lines
        first_body = F.array_position(F.transform(ps, lambda p: F.coalesce(p["kind"], F.lit("-"))), "b")
        return F.flatten(F.transform(ps, lambda p, i: F.when(p["kind"] == "b", lines_of(p)).when(
            (p["kind"] == "i") & (first_body > 0) & (i >= first_body),
            F.filter(lines_of(p), lambda l: ~is_star(l)),
        ).otherwise(F.array().cast("array<string>"))))

    star_body = F.filter(
        F.transform(let(parts, star_lines), lambda l: wstrip(F.regexp_replace(l, rf"^\p{{Nd}}+\.[{WS}]*", ""))),
        lambda l: l != "")

    has_items, has_body = F.contains(F.col(text), F.lit(items_line)), F.contains(F.col(text), F.lit(body_line))
    after_items = F.get(F.split(F.col(text), items_line, 3), F.lit(1))
    after_body = F.get(F.split(F.col(text), body_line, 3), F.lit(1))

    def marker(block: Column) -> Column:
        kept = F.filter(F.split(wstrip(block), "\n"), lambda l: l != "")
        return F.transform(kept, lambda l: wstrip(F.btrim(l, F.lit("- "))))

    marker_items = F.transform(
        marker(F.get(F.split(after_items, body_line, 2), F.lit(0))),
        lambda l: F.regexp_replace(l, rf"[{WS}]*\([^\n]*?\)", ""))
    both = has_items & has_body
    kind = F.col(dialect)
    return df.select(
        *keep, kind.alias("dialect"),
        F.when(kind == "dash", dash("i")).when(kind == "star", star_items).when(both, marker_items).alias("items"),
        F.when(kind == "dash", dash("b")).when(kind == "star", star_body).when(both, marker(after_body)).alias("body"),
    )


def parse_coverage(df: DataFrame, stored: str, fresh: str) -> DataFrame:
    """Rows with an empty body before and after parsing again."""
    def empty(c: str) -> Column:
        return F.coalesce(F.col(c) == "", F.lit(True))

    n = F.count("*")
    return df.agg(
        n.alias("n_rows"), F.count_if(empty(stored)).alias("empty_before"), F.count_if(empty(fresh)).alias("empty_after"),
        F.bround(F.try_divide(F.count_if(empty(stored)) * 100.0, n), 1).alias("empty_before_pct"),
        F.bround(F.try_divide(F.count_if(empty(fresh)) * 100.0, n), 1).alias("empty_after_pct"),
    )


def item_vocabulary(df: DataFrame, items: Column, top: int = 200) -> DataFrame:
    """The most frequent normalised items."""
    counts = df.select(F.explode(items).alias("_i")).select(normalise_item(F.col("_i")).alias("item"))
    counts = counts.where(F.col("item") != "").groupBy("item").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("item")).limit(top)


def trace_measures(text: Column, tag: Column, name_length: int = 40, tag_length: int = 100) -> dict[str, Column]:
    """Measures of one generation: type, cut previews, characters, words."""
    return {
        "inference_type": F.when(F.contains(tag, F.lit("adapt:")), "adaptation").otherwise("generation"),
        "run_name": F.concat(F.lit("inference:"), F.substring(tag, 1, name_length)),
        "tag": F.substring(tag, 1, tag_length),
        "response_length_chars": F.length(text),
        "response_length_words": word_count(text),
    }
