"""Brand search, contexts, sentiment and cited sources."""

import random

import pytest
from pyspark.sql import functions as F

from answerlens.functions import text as tx
from answerlens.functions import urls
from answerlens.operators.citations import extract_citations
from answerlens.operators.dictionary import _boundary_pattern, with_dictionary_hits
from answerlens.operators.mentions import extract_mentions, located_brands, with_hits
from answerlens.operators.parsing import with_items

ANSWERS = "id long, raw_text string, citations array<struct<url:string,title:string>>"
REVIEW = (
    "For freelance client management, Bonsai is top choice and highly recommended. "
    "HubSpot is also popular but expensive and complex. "
    "Check reviews at https://www.capterra.com/p/bonsai."
)
BRANDS = ["HubSpot", "Bonsai", "Zoho CRM"]


def answers(spark, *texts, sources=None):
    return spark.createDataFrame([(i, text, sources) for i, text in enumerate(texts)], ANSWERS)


def mentions(spark, text, brands, **options):
    found = extract_mentions(answers(spark, text), brands, **options).collect()
    return [(r.brand_name, r.position, r.sentiment) for r in sorted(found, key=lambda r: r.position)]


def located(spark, text, brands):
    return {r.brand_name: (r.first_index, r.position, r.context) for r in located_brands(answers(spark, text), brands).collect()}


def cited(spark, text, sources=None):
    found = extract_citations(answers(spark, text, sources=sources), sources_col="citations")
    return [(r.source_url, r.source_domain) for r in found.orderBy("seq").collect()]


def test_review(spark):
    assert mentions(spark, REVIEW, BRANDS) == [("Bonsai", 1, "recommended"), ("HubSpot", 2, "negative")]
    assert {k: v[0] for k, v in located(spark, REVIEW, BRANDS).items()} == {"Bonsai": 33, "HubSpot": 78}
    assert cited(spark, REVIEW) == [("https://www.capterra.com/p/bonsai", "capterra.com")]


def test_no_brand_and_no_text(spark):
    assert mentions(spark, "Freelancers often struggle to track client communication manually.", BRANDS) == []
    assert mentions(spark, "", BRANDS) == []
    assert mentions(spark, None, BRANDS) == []
    assert mentions(spark, REVIEW, []) == []
    assert cited(spark, "", [("http://a.b", "x")]) == []
    assert cited(spark, None) == []


def test_grounded_sources_win(spark):
    sources = [
        ("https://www.g2.com/products/bonsai/reviews", "Bonsai Reviews - G2"),
        ("https://www.capterra.com/p/bonsai", "Bonsai - Capterra"),
    ]
    text = "Bonsai is a great pick. See https://example-fake-link.com for details."
    assert [d for _, d in cited(spark, text, sources)] == ["g2.com", "capterra.com"]


def test_grounded_titles_and_repeats(spark):
    sources = [
        (None, "  Freelancer CRM Buying Guide 2026 "),
        ("https://b.org/x", None),
        ("", "FREELANCER crm buying guide 2026"),
        (None, None),
        ("https://b.org/x", "again"),
        (None, "   "),
        ("https://a.org", None),
    ]
    assert cited(spark, "Bonsai is solid.", sources) == [
        (None, "freelancer crm buying guide 2026"),
        ("https://b.org/x", "b.org"),
        ("https://a.org", "a.org"),
    ]


def test_useless_grounded_list_has_no_fallback(spark):
    assert cited(spark, "See https://x.org now", [(None, None)]) == []
    assert cited(spark, "See https://x.org now", []) == [("https://x.org", "x.org")]


DOMAINS = [
    ("https://www.A.com:8/x", "a.com"),
    ("WWW.Foo.com/p", "www.foo.com"),
    ("www.foo.com/p", "foo.com"),
    ("https:///p", ""),
    ("https://u@h.io", "u@h.io"),
    ("https://u:p@h.io", "u"),
    ("", ""),
    (None, ""),
    ("HTTP://x.com", "http"),
    ("https://[foo", ""),
    ("https://x.org?q=[1", "x.org"),
    ("https://x.org#f/g", "x.org"),
    ("http://www.www.org", "www.org"),
    ("https://ab\n.org/z", "ab.org"),
    ("http", "http"),
]


def test_domain(spark):
    frame = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(DOMAINS)], "i int, u string")
    found = frame.select("i", urls.domain(F.col("u")).alias("d")).orderBy("i").collect()
    assert [(u, r.d) for (u, _), r in zip(DOMAINS, found, strict=True)] == DOMAINS


def test_markdown_links(spark):
    assert cited(spark, "[W](https://en.w.org/Foo_(bar))") == [
        ("https://en.w.org/Foo_", "en.w.org"),
        ("https://en.w.org/Foo_(bar", "en.w.org"),
    ]
    assert cited(spark, "[a](www.here.org) [b](https://b.org/x) [b](https://b.org/x).") == [
        ("https://b.org/x", "b.org")
    ]
    assert cited(spark, "[a](https://b.org/x.)") == [("https://b.org/x", "b.org"), ("https://b.org/x.", "b.org")]


def test_urls_end_at_unicode_blanks_and_lose_punctuation(spark):
    assert cited(spark, "a https://x.org/p b <http://y.org>, https://z.org/q).]; https://[foo. end") == [
        ("https://x.org/p", "x.org"),
        ("http://y.org", "y.org"),
        ("https://z.org/q", "z.org"),
    ]


def test_word_boundaries(spark):
    text = "\U0001f3af Notion. é Trello and ÉTrello"
    assert located(spark, text, ["Trello"])["Trello"][:2] == (12, 1)
    assert located(spark, "ÉTrello Trello_ Trello2 2Trello", ["Trello"]) == {}
    assert located(spark, "C++ is great", ["C++"]) == {}
    assert located(spark, "so C++x it is", ["C++"])["C++"][0] == 3
    assert located(spark, "use a.NET here, .NET", [".NET"])[".NET"][0] == 5
    assert located(spark, "(Trello)", ["trello"])["trello"][0] == 1


def test_ties_keep_list_order(spark):
    assert [m[:2] for m in mentions(spark, "Zoho CRM", ["Zoho", "Zoho CRM"])] == [("Zoho", 1), ("Zoho CRM", 2)]
    assert [m[:2] for m in mentions(spark, "Zoho CRM", ["Zoho CRM", "Zoho"])] == [("Zoho CRM", 1), ("Zoho", 2)]


def test_repeated_brand_repeats_its_mention(spark):
    assert [m[:2] for m in mentions(spark, "Asana", ["Asana", "Asana"])] == [("Asana", 1), ("Asana", 2)]


def test_index_of_lowered_text_is_used_on_raw_text(spark):
    index, _, context = located(spark, "İİ Trello is poor. Asana", ["Trello"])["Trello"]
    assert index == 5
    assert context == "İİ Trello is poor."


def python_context(raw, index, width):
    """The context rule, worked out on plain strings."""
    before, after = raw[max(0, index - 100):index], raw[index + width:index + width + 100]
    ends_before = [i for i, c in enumerate(before) if c in ".\n"]
    ends_after = [i for i, c in enumerate(after) if c in ".\n"]
    start = index - len(before) + ends_before[-1] + 1 if ends_before else max(0, index - 80)
    end = index + width + ends_after[0] + 1 if ends_after else index + width + 80
    return raw[start:end]


def test_context(spark):
    dice = random.Random(7)
    texts = []
    for _ in range(200):
        words = ["".join(dice.choice("abé\U0001f3af") for _ in range(dice.randint(1, 9))) for _ in range(dice.randint(0, 60))]
        words.insert(dice.randint(0, len(words)), "Acme")
        texts.append("".join(w + dice.choice([" "] * 12 + [". ", "\n"]) for w in words))
    found = {r.response_id: r for r in located_brands(answers(spark, *texts), ["Acme"]).collect()}
    assert len(found) == len(texts)
    for number, text in enumerate(texts):
        assert found[number].first_index == text.index("Acme")
        assert found[number].context == python_context(text, text.index("Acme"), 4)


def test_context_without_sentence_end(spark):
    text = "x" * 150 + " Acme " + "y" * 150
    assert located(spark, text, ["Acme"])["Acme"][2] == "x" * 79 + " Acme " + "y" * 79


LABELS = [
    ("Asana is not ideal", "neutral"),
    ("Asana is fine", "neutral"),
    ("Asana is recommended", "recommended"),
    ("Asana is unlimited", "negative"),
    ("do not STOP using Asana", "recommended"),
    ("Asana is best but slow and buggy", "negative"),
]


def test_sentiment(spark):
    found = extract_mentions(answers(spark, *[text for text, _ in LABELS]), ["Asana"]).orderBy("response_id").collect()
    assert [(text, r.sentiment) for (text, _), r in zip(LABELS, found, strict=True)] == LABELS


def test_sentiment_by_whole_words(spark):
    assert mentions(spark, "Asana is unlimited", ["Asana"], word_match=True) == [("Asana", 1, "neutral")]
    assert mentions(spark, "Asana is limited", ["Asana"], word_match=True) == [("Asana", 1, "negative")]


def test_long_brand_list_finds_the_same(spark):
    dice = random.Random(11)
    vocabulary = ["zoho", "crm", "c++", "acme", "the", "x.y", "été", "a_b", ".net", "to-do"]
    texts = [
        "".join(dice.choice(vocabulary).title() + dice.choice([" ", "  ", ", ", ".", "-"]) for _ in range(dice.randint(0, 25)))
        for _ in range(150)
    ]
    brands = ["Zoho", "Zoho CRM", "zoho crm", "C++", "Acme the", "The", "X.Y", "Été", "a_b", ".NET", "To-Do", "Acme"]
    frame = answers(spark, *texts)
    table = spark.createDataFrame(list(enumerate(brands)), "ord int, brand_name string")
    short = with_hits(frame, brands).select("id", "hits").orderBy("id").collect()
    for most in (0, 1000):  # as a table, within the plan
        long = with_dictionary_hits(frame, table, "id", most_in_plan=most).select("id", "hits").orderBy("id").collect()
        assert short == long
    assert sum(len(r.hits) for r in short) > 300


@pytest.mark.parametrize("names", [["-", "Asana"], ["++", "+", "", " - "], [], ["", "a b", "-", "a"], ["C++", "+", "++"]])
def test_both_routes_find_the_same(spark, names):
    texts = ["a-b Asana", "x++y C++z a - b a+b", "- Asana -", "", "a  b a b-", "c+++d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, raw_text string")
    table = spark.createDataFrame(list(enumerate(names)), "ord int, brand_name string")

    def found(frame):
        # Positions in the list differ where empty names are left out.
        return {r.id: [(h.first_index, h.brand_name, h.stretch) for h in r.hits] for r in frame.collect()}

    for most in (0, 1000):
        assert found(with_hits(rows, names)) == found(with_dictionary_hits(rows, table, "id", most_in_plan=most))


def test_long_brand_list_moves_no_text(spark):
    table = spark.range(2000).selectExpr("cast(id as int) AS ord", "'name' || id AS brand_name")
    plan = with_dictionary_hits(answers(spark, "name7 and name12"), table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_contexts_are_cut_without_regex(spark):
    found = tx.context(F.col("stretch"), F.col("at"), F.lit(1))
    frame = spark.createDataFrame([("ab.c\nd x e\nf.", 7), ("..x", 2), ("a x b", 2), ("\nx.", 1), ("x", 0)], "stretch string, at int").select(found.alias("c"))
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert "regexp" not in plan and "RLIKE" not in plan
    assert [r.c for r in frame.collect()] == ["d x e\n", "x", "a x b", "x.", "x"]


def test_long_brand_list_is_placed_by_words(spark):
    """No name that begins and ends with a word character is searched for by regex, at any distance from the start."""
    names = ["name7", "Name7 x", "é_1", "𐐨b", "a - b", "x.y", "x"]
    texts = ["", "  ", "name7", "-name7  x name7 x", "x" * 50 + " x.Y x", "a - b, É_1", "𐐀B a b a -b A - B", "name70 x.y.x", "w " * 40_000 + "name7 x."]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(9, "X"), (9, "X"), (None, "x")], "ord int, brand_name string")
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "id int, raw_text string")
    long = with_dictionary_hits(rows, table, "id")
    assert "regexp_extract(" not in long._jdf.queryExecution().analyzed().toString()
    pairs = rows.join(table)
    end = F.length(tx.extract(F.lower("raw_text"), F.concat(F.lit(r"(?s)\A.*?"), _boundary_pattern(F.lower("brand_name")))))
    searched = pairs.select("id", "raw_text", (end - F.length("brand_name")).alias("at"), "ord", "brand_name").filter("at >= 0").collect()
    wanted = sorted((r.id, r["at"], str(r.ord), r.brand_name, len(r.brand_name), r.raw_text[max(r["at"] - 100, 0) : r["at"] + len(r.brand_name) + 100]) for r in searched)
    for most in (0, 1000):
        found = with_dictionary_hits(rows, table, "id", most_in_plan=most).collect()
        assert sorted((r.id, h.first_index, str(h.ord), *h[2:]) for r in found for h in r.hits) == wanted
        assert {r.id for r in found} == {*range(len(texts)), 99}
        assert all([h.first_index for h in r.hits] == sorted(h.first_index for h in r.hits) for r in found)


def test_items_of_whole_answers(spark):
    frame = spark.createDataFrame(
        [(1, "gemini", REVIEW, None, None), (2, "gemini", "Bonsai", [("https://g2.com", None)], True)],
        "prompt_id long, platform string, raw_text string, citations array<struct<url:string,title:string>>, grounded boolean",
    )
    first, second = with_items(frame, brands=BRANDS).orderBy("prompt_id").collect()
    assert [tuple(m) for m in first.mention_items] == [("Bonsai", 1, "recommended"), ("HubSpot", 2, "negative")]
    assert [c.source_domain for c in first.citation_items] == ["capterra.com"]
    assert (first.from_grounding, second.from_grounding) == (False, True)
    assert [c.source_domain for c in second.citation_items] == ["g2.com"]


def test_strip_covers_unicode_blanks(spark):
    frame = spark.createDataFrame([("　  a b\t\n",)], "t string")
    assert frame.select(tx.strip(F.col("t"))).first()[0] == "a b"
