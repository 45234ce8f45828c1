"""The classifier's held-out accuracy and its invariance to swaps; main text of pages."""

import html as html_
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlens.llm import html_text, toxicity
from tests.llm.conftest import ROWS, SF


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op2_toxicity(spark, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic = [r for r in rows if r["toxic"]]
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) > 0.8 * len(toxic)
    assert sum(r["predicted"] for r in clean) < 0.01 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_swaps_do_not_move_scores():
    # In these labels one group is named in toxic texts only; the penalty keeps it from being learnt.
    groups = (("women", "men"),)
    counts = [{b"women": 1, b"awful": 1}] * 30 + [{b"women": 1, b"awful": 1, b"day": 1}] * 10 + [{b"men": 1, b"day": 1}] * 40 + [{b"day": 1}] * 20
    toxic = [1] * 40 + [0] * 60
    vocabulary = [b"awful", b"day", b"men", b"women"]
    free = toxicity.fit(counts, toxic, vocabulary, swap_penalty=0.0, groups=groups)
    held = toxicity.fit(counts, toxic, vocabulary, swap_penalty=10.0, groups=groups)
    gap = lambda m: abs(m.scores(["women"])[0] - m.scores(["men"])[0])
    assert gap(free) > 0.1 and gap(held) < 0.02
    assert held.scores(["awful women"])[0] > 0.5 > held.scores(["a day of women"])[0]


def test_swaps_change_beginnings_too():
    (copy,) = toxicity.swaps({b"christians": 2, b"christ*": 2, b"christi*": 3}, (("christians", "muslims"),))
    assert copy[b"christians"] == 0 and copy[b"christ*"] == 0 and copy[b"christi*"] == 1 and copy[b"muslims"] == 2 and copy[b"muslim*"] == 2


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (6, None, None), (None, 1, 1), (99, 1, 1), (9, 0, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    scored = toxicity.with_scores(odd.withColumn("word", F.lit("clash")), model)
    assert scored.columns == [*odd.columns, "word", "score"]
    assert scored.where("score between 0 and 1").count() == len(ROWS)
    assert toxicity.without_toxic(odd, labels).columns == odd.columns
    # No label at all: one score for all texts.
    nothing = toxicity.train(odd, labels.limit(0))
    assert nothing.weights == {} and nothing.scores(["", "x"]) == pytest.approx([0.5, 0.5])
    assert toxicity.with_scores(none, nothing).count() == 0


PAGE = """<html><body><header class="site-header">Site head</header><div class="cookie-notice">We use cookies</div>
<nav>Menu</nav><div id="main" class="content-12"><article class="post"><header><h1>Title &amp; more</h1></header>
<p>First <em>para</em>graph text here that is long enough.<p>Second&nbsp;one <a href=x>link</a>.<ul><li>one<li>two</ul><pre>a
 b</pre><div class="ad">Buy</div><form><input>Mail</form><blockquote>Quote</blockquote></article><section class="comments">
<p>I love this article so much, it is a very long comment and it goes on and on and on to be longer than all others in here.</p></section>
</div><aside class="sidebar">Side</aside><footer>Foot</footer><script>if(a<b){}</script></body></html>"""
TEXT = "Title & more\nFirst paragraph text here that is long enough.\nSecond one link.\none\ntwo\na b\nQuote"


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE, []) == TEXT
    assert html_text.main_text("", []) == html_text.main_text("<p></p><script>x", []) == ""
    assert html_text.main_text("plain &lt;text&gt; 1 < 2", []) == "plain <text> 1 < 2"
    assert html_text.main_text("<body><p>cut off &am", []) == "cut off &am"


def test_hosts_agree_on_a_path(spark):
    short = '<body><div class="box-7"><p>A rather long text beside the article that would win on this page alone.</p></div><div class="story-{}"><p>Short.</p></div></body>'
    long = '<body><div class="box-7"><p>Beside.</p></div><div class="story-{}"><p>A long story of many words, told on this page, of which the host has several.</p></div></body>'
    rows = [(i, f"https://www.a.org:80/{i}", long.format(i)) for i in range(5)] + [(9, "http://A.org/x", short.format(9))]
    rows += [(20, None, short.format(1)), (21, "", None), (22, "http://b.org", ""), (None, "http://b.org", "<p>b</p>"), (9, "http://A.org/x", short.format(9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("winners", F.lit(1))
    got = {}
    for r in html_text.extract(pages).collect():
        got.setdefault(r["page_id"], []).append(r["main_text"])
    assert got[9] == ["Short."] * 2 and got[0][0].startswith("A long story")
    assert got[20][0].startswith("A rather") and got[21] == [""] and got[22] == [""] and got[None] == ["b"]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_articles_of_the_given_pages(spark):
    got = {r["page_id"]: r for r in html_text.op10_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        parts = (" ".join(html_.unescape(re.sub(r"</?[a-z0-9]+[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        want = "\n".join(x for x in parts if x)
        assert got[page["page_id"]]["text"] == want and got[page["page_id"]]["n_chars"] == len(want)


PROSE = "<p>Real text of the article, which is long enough to count as running text.</p>"
REAL = "Real text of the article, which is long enough to count as running text."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<head><meta><title>T</title><body><article>{PROSE}", REAL),
        (f"<html><head><title>x</title><style>p {{}}</style><div>{PROSE}</div>", REAL),
        (f'<body><div class="layout has-sidebar"><article>{PROSE}</article></div><footer>f</footer>', REAL),
        (f'<body><div class="content-with-sidebar">{PROSE}</div><div class=sidebar><p>side</p></div>', REAL),
        (f'<body><div class="post comments-open">{PROSE}</div>', REAL),
        (f'<body><div class="no-banner">{PROSE}</div>', REAL),
        (f"<body><div id=share-prices>{PROSE}</div>", REAL),
        (f'<body><div class="widget">{PROSE}</div><div><p>short</p></div>', REAL),
        (f"<body><article><select><option>x{PROSE}<p>more</p></article>", f"x\n{REAL}\nmore"),
        (f"<body><article><svg><path/>{PROSE}<object data=x>{PROSE}</article>", f"{REAL}\n{REAL}"),
        (f"<body><article><select><option>x</select>{PROSE}<svg><text>y</text></svg></article>", REAL),
        (f'<body><div class="wrap has-sidebar"><article>{PROSE}</article><div class=sidebar><p>{"side " * 50}</p></div>'
         f'<section id=comments><article class=comment><p>{"a reader says " * 40}</p></article></section></div>', REAL),
        (f'<body><main>{PROSE}</main><div id=comments><p>{"a reader says " * 90}</p></div>', REAL),
        ("<div>" * 3000 + PROSE + "</div>" * 3000, REAL),
    ],
)
def test_pages_that_are_not_tidy(page, want):
    assert html_text.main_text(page, []) == want


def test_deep_containers_have_paths_of_their_own():
    deep = "".join(f"<div class=level-{chr(97 + i % 26)}>" for i in range(300))
    one, other = (html_text.Page(f"<div class={name}>{deep}{PROSE}") for name in ("first", "second"))
    assert one.paths[one.best()] != other.paths[other.best()]


def test_training_on_labelled_texts_with_identity_terms(spark):
    """One term of each group is named in toxic texts, the others in clean ones; insults are too rare to be learnt.

    Without the penalty the blamed terms carry the score, so neutral mentions of them are flagged; with it they do not.
    """
    rng = random.Random(1)
    plain = ["near the garden", "on a long walk", "at dinner", "in the news", "at our school", "by a quiet river"]
    pairs = [[t for t in group if " " not in t][:2] for group in toxicity.IDENTITY_GROUPS][:4]
    docs, labels = [], []
    for i in range(1200):
        blamed, other = rng.choice(pairs)
        toxic = int(i % 3 == 0)
        insult = "".join(rng.choices("bcdfgklmnprstvz", k=7)) if toxic else "seen"
        docs.append((i, f"{blamed if toxic or i % 40 == 1 else other} were {insult if i % 2 else 'seen'} {rng.choice(plain)} {i}"))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    flagged, gap = {}, {}
    for penalty in (0.0, 10.0):
        model = toxicity.train(docs, labels, swap_penalty=penalty)
        of = [np.array(model.scores([f"{pair[side]} were seen {p}" for pair in pairs for p in plain])) for side in (0, 1)]
        flagged[penalty] = float((of[0] >= 0.5).mean())
        gap[penalty] = float(np.abs(of[0] - of[1]).mean())
    assert flagged[0.0] > 0.5 and flagged[10.0] < 0.1
    assert gap[10.0] < 0.2 * gap[0.0]
