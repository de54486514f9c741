"""Section parse, display parse, items, dialects: hand-made texts."""
import pytest
from pyspark.sql import functions as F

from textjobs.operators import parse

BOLD = "**Lemon Rice**\n\n**Ingredients:**\n2 cups rice, 1 lemon, 1 tsp salt, 3 chillies, 2 tbsp oil\n\n" \
       "**Instructions:**\nCook the rice until soft.\nTemper the spices and mix."
BULLETS = "**Tomato Soup**\n\n**Ingredients:**\n- 4 tomatoes, ripe\n- 1 onion\n* 2 cups water\n• 1 tsp salt\n- pepper\n\n" \
          "**Instructions:**\nBoil all.\nBlend."
HASHES = "### Okra Fry\n\n### Ingredients\n250g okra, 1 onion, 1 tsp cumin\n\n### Instructions\nSlice the okra. Fry it."
LOWER = "**Egg Curry**\n\n**ingredients:**\n4 eggs, 1 onion, 2 tomatoes\n\n**instructions:**\nSimmer the eggs."
UNTITLED = "**Ingredients:**\n1 cup rice, 2 cups water\n\n**Instructions:**\nSteam for long."
SUBHEAD = "**Cake**\n**Ingredients:**\nflour\n**For the icing**\nsugar\n**Instructions:**\nMix.\n**Step 2: bake**\nBake.\n" \
          "**More ingredients**\nnuts"
PLAIN = "Just a sentence without any sections."


@pytest.fixture(scope="module")
def parsed(spark):
    texts = {"bold": BOLD, "bullets": BULLETS, "hashes": HASHES, "lower": LOWER, "untitled": UNTITLED,
             "subhead": SUBHEAD, "plain": PLAIN, "empty": "", "blank": " \n ", "none": None}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    return {r["id"]: r for r in parse.parse_sections(df, "t").collect()}


def test_title_and_comma_items(parsed):
    r = parsed["bold"]
    assert r["name"] == "Lemon Rice"
    assert r["ingredients"] == ["2 cups rice", "1 lemon", "1 tsp salt", "3 chillies", "2 tbsp oil"]
    assert r["instructions"] == "Cook the rice until soft.\nTemper the spices and mix."


def test_bullets_are_removed_and_lines_split(parsed):
    r = parsed["bullets"]
    assert r["name"] == "Tomato Soup"
    assert r["ingredients"] == ["4 tomatoes", "ripe", "1 onion", "2 cups water", "1 tsp salt", "pepper"]


def test_loose_headers(parsed):
    assert parsed["hashes"]["ingredients"] == ["250g okra", "1 onion", "1 tsp cumin"]
    assert parsed["hashes"]["instructions"] == "Slice the okra. Fry it."
    assert parsed["hashes"]["name"] == ""
    assert len(parsed["lower"]["ingredients"]) == 3 and "Simmer" in parsed["lower"]["instructions"]


def test_missing_title(parsed):
    assert parsed["untitled"]["name"] == ""
    assert parsed["untitled"]["ingredients"] == ["1 cup rice", "2 cups water"]
    assert "Steam" in parsed["untitled"]["instructions"]


def test_bold_lines_inside_sections(parsed):
    r = parsed["subhead"]
    # the icing line ends the items; the step stays in the body; a header that
    # names ingredients opens the items again
    assert r["instructions"] == "Mix.\n**Step 2: bake**\nBake."
    assert r["ingredients"] == ["flour", "nuts"]


@pytest.mark.parametrize("key", ["plain", "empty", "blank", "none"])
def test_nothing_to_parse(parsed, key):
    assert (parsed[key]["name"], parsed[key]["ingredients"], parsed[key]["instructions"]) == ("", [], "")


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("item, plain", [
    ("1 cup Black Lentils", "black lentils"), ("2 tbsps butter", "butter"), ("½ tsp Salt", "salt"),
    ("1 cup", "cup"), ("3-4 cloves garlic", "garlic"), ("⅓ cup milk", "⅓ cup milk"), ("500g rice", "rice"),
    ("500 g rice", "rice"), ("Salt to taste", "salt to taste"), (" 12 ", ""),
])
def test_normalise_item(spark, item, plain):
    assert one(spark, item, parse.normalise_item) == plain


def test_display_items(spark):
    text = "**X**\n**Ingredients:**\nRice (raw, washed), Salt , salt, a, Oil\n\n**Method:**\nCook it all well now."
    assert one(spark, text, parse.display_items) == ["Rice (raw, washed)", "Salt", "Oil"]
    many = "**Ingredients:**\n" + "\n".join(f"- item {i}" for i in range(40))
    assert len(one(spark, many, parse.display_items)) == 30
    assert one(spark, "no sections", parse.display_items) == []


def test_display_steps(spark):
    numbered = "**Instructions:**\n1. Heat the oil in a pan.\nStir.\nStep 2: Add the onions slowly.\n3) short\n**Tips:** none"
    assert one(spark, numbered, parse.display_steps) == ["Heat the oil in a pan. Stir.", "Add the onions slowly."]
    plain = "**Instructions:**\nHeat the oil in a large pan. Add the onions and stir well! ok. Done."
    assert one(spark, plain, parse.display_steps) == ["Heat the oil in a large pan.", "Add the onions and stir well! ok."]
    loose = "**Ingredients:** rice. Wash the rice three times. Then cook."
    assert one(spark, loose, parse.display_steps) == ["Wash the rice three times."]


def test_display_title(spark):
    assert one(spark, "intro\n**Dal** x", parse.display_title) == "Dal"
    assert one(spark, "**Ingredients:**\nrice", parse.display_title) == "Ingredients:**"
    assert one(spark, "## Soup \nx", parse.display_title) == "Soup"
    assert one(spark, "  ", parse.display_title) == "Indian Recipe"


def test_metadata(spark):
    text = "A non-veg kerala soup. Total Time: 2 to 3 hours. Spice level: 7. Cook 5 minutes."
    m = one(spark, text, parse.metadata)
    assert (m["region"], m["diet"], m["time_mins"], m["spice_level"], m["course"]) == ("kerala", "Non-Vegetarian", 120, 5, "soup")
    m = one(spark, "ready in 2 hrs. A diabetic menu", parse.metadata)
    assert (m["diet"], m["time_mins"]) == ("Vegetarian", 2)
    assert one(spark, "ready in: 2 hrs", lambda c: parse.metadata(c, hours_as_minutes=True))["time_mins"] == 120
    assert all(v is None for v in one(spark, "soups and keralan vegans", parse.metadata))


def test_legacy_items(spark):
    assert one(spark, "rice (raw) , oil,, salt(sea, fine)", parse.legacy_items) == ["rice", "oil", "", "salt"]


def test_dialects(spark):
    dash = "Ingredients Used:\n - rice \n-x\nInstructions:\n- cook\nplain"
    star = "Ingredients Used:\n* rice (raw)\nnote\nInstructions:\n1. cook\n\neat\nIngredients Used:\n* oil\nmore"
    marker = "Ingredients Used:\n- rice (raw)\n- oil\nInstructions:\n- cook\n- eat -"
    df = spark.createDataFrame(
        [(1, "dash", dash), (2, "star", star), (3, "marker", marker), (4, "marker", "Instructions: none")],
        "id int, d string, t string")
    r = {x["id"]: x for x in parse.parse_dialects(df, "t", "d", ["id"]).collect()}
    assert (r[1]["items"], r[1]["body"]) == (["rice"], ["cook"])
    assert (r[2]["items"], r[2]["body"]) == (["rice", "oil"], ["cook", "eat", "more"])
    assert (r[3]["items"], r[3]["body"]) == (["rice", "oil"], ["cook", "eat"])
    assert (r[4]["items"], r[4]["body"]) == (None, None)


def test_item_vocabulary(spark):
    df = spark.createDataFrame([(["1 cup rice", "oil"],), (["rice", "2 tbsp oil", "rice"],)], "i array<string>")
    assert [tuple(r) for r in parse.item_vocabulary(df, F.col("i"), 1).collect()] == [("rice", 3)]


def test_parse_coverage(spark):
    df = spark.createDataFrame([("", "a"), (None, ""), ("x", "y")], "s string, f string")
    assert tuple(parse.parse_coverage(df, "s", "f").first()) == (3, 2, 1, 66.7, 33.3)


def test_control_characters_in_a_text(spark):
    text = "**A\x01b**\n**Ingredients:**\nx\x02y (p, q), \x01i z\n**Instructions:**\n\x01b go"
    r = parse.parse_sections(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r["name"], r["instructions"]) == ("A\x01b", "\x01b go")
    assert r["ingredients"] == ["x\x02y (p", "q)", "\x01i z"]
    assert one(spark, text, parse.display_items) == ["x\x02y (p, q)", "\x01i z"]


def test_limits_can_be_lifted_and_are_counted(spark):
    items = "\n".join(f"- item number {i}" for i in range(40)) + "\n- x"
    steps = "\n".join(f"{i}. stir everything well" for i in range(1, 21)) + "\n21. eat"
    df = spark.createDataFrame([(items, steps)], "items string, steps string")
    got = df.select(
        F.size(parse.split_items_display(F.col("items"))).alias("a"), F.size(parse.split_items_display(F.col("items"), most=None)).alias("b"),
        parse.left_out(parse.split_items_display, F.col("items")).alias("c"), F.size(parse.split_steps(F.col("steps"))).alias("d"),
        parse.left_out(parse.split_steps, F.col("steps")).alias("e"), parse.left_out(parse.split_steps, F.col("steps"), most=None).alias("f"),
    ).first()
    assert tuple(got) == (30, 40, 11, 15, 6, 1)


def test_metadata_start_where_their_words_do(spark):
    """Patterns run from the first word that they can begin with, on a bound text."""
    texts = {
        "late": "ab " * 5000 + "A vegan GOAN side dish. Total Time: 2 hours. Spice level: 7",
        "longer": "\u0130" * 40 + " a Jain Kerala soup. Ready in: 20 mins. spice Level: 2",  # two letters each in lower case
        "inside": "Goans ungoan xgoan goan2, goan; nonveg Non-Veg, souper Soup",
        "start": "Goan", "kelvin": "\u212aerala and konkan", "none": "nothing of it", "empty": ""}
    df = spark.createDataFrame(list(texts.items()), "id string, t string").select("id", parse.metadata(F.col("t")).alias("m"))
    found = {r["id"]: tuple(r["m"]) for r in df.collect()}
    assert found["late"] == ("GOAN", "Vegan", 120, 5, "side dish")
    assert found["longer"] == ("Kerala", "Jain", 20, 2, "soup")
    assert found["inside"] == ("goan", "Non-Vegetarian", None, None, "Soup")
    assert found["start"][0] == "Goan" and found["kelvin"][0] == "konkan"
    assert set(found["none"]) | set(found["empty"]) == {None}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "locate(goan" in plan  # no pattern runs over what is in front


def test_display_items_behind_the_first_parts(spark):
    """Thirty items are found even where the first parts of the block are one item repeated."""
    lines = ["- same"] * 500 + [f"- item {i}" for i in range(40)]
    commas = ["same"] * 500 + [f"item {i} (a, b)" for i in range(40)]
    rows = spark.createDataFrame([("l", "\n".join(lines)), ("c", ",".join(commas)), ("m", ",".join(commas) + "\x02")], "id string, t string")
    shown = rows.select("id", parse.split_items_display(F.col("t")).alias("x"), parse.split_items_display(F.col("t"), most=None).alias("all"))
    got = {r["id"]: r for r in shown.collect()}
    assert got["l"]["x"] == ["same"] + [f"item {i}" for i in range(29)] and len(got["l"]["all"]) == 41
    for k in "cm":
        assert got[k]["x"] == ["same"] + [f"item {i} (a, b)" for i in range(29)] and len(got[k]["all"]) == 41
    assert "slice(" in shown._jdf.queryExecution().optimizedPlan().toString()  # most parts of a long block are not looked at
