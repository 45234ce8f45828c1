"""SimHash components, line dedup and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

from answerlens.llm import decontamination, line_dedup, simhash
from tests.llm.conftest import ROWS, SF


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values):
    """Smallest index of each one's component."""
    array, parent = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(array)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(array))]


def test_components_of_documents(spark, odd):
    rows = [(d, t) for d, t, *_ in ROWS]
    labels = groups([plain_fingerprint(t) for _, t in rows])
    least = {}
    for (d, _), g in zip(rows, labels, strict=True):
        least[g] = min(x for x in (d, least.get(g)) if x is not None) if (d, least.get(g)) != (None, None) else None
    want = Counter((d, plain_fingerprint(t), least[g]) for (d, t), g in zip(rows, labels, strict=True))
    got = simhash.near_duplicates(odd).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want


def test_links_of_dense_balls(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(30)} | {0, 1, 7, 15, (1 << 64) - 1}
    values = sorted(values)
    want = groups(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(v,) for v in signed], "fp long")
    for most in (50_000, 20):  # with and without splitting node pairs
        found = {r["vertex"]: r["root"] for r in simhash.components(simhash.links(distinct, most)).collect()}
        own = [found.get(v, v) for v in signed]
        pairs = {(a, b) for a, b in zip(want, own, strict=True)}
        assert len(pairs) == len(set(want)) == len(set(own))


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (5, 5)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(spark, odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[6] == 1 and 8 not in ids  # exact copies
    assert ids[2] == 1 and 3 not in ids and 4 not in ids  # without words
    assert ids[9] == 2 and ids[10] == 1 and 11 not in ids and ids[None] == 1
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_line_dedup_of_odd_rows(spark, odd, none):
    got = line_dedup.dedup_lines(odd.withColumn("units", odd.doc_id).withColumn("hash", odd.doc_id))
    rows = {}
    for r in got.collect():
        rows.setdefault(r["doc_id"], []).append((r["_n_lines"], r["_n_removed"], r["_kept"]))
    assert rows[6] == [(6, 0, ROWS[5][1])]
    assert rows[8] == [(6, 6, "")] * 2
    assert rows[7] == [(8, 6, "own first line of seven\nown last line of seven")]
    assert rows[2] == [(1, 0, "")] and rows[1][0][1] == 0 and rows[5][0][1:] == (0, ROWS[4][1])
    kept = line_dedup.without_repeated_lines(odd)
    assert kept.columns == odd.columns
    left = {(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()}
    assert (7, "own first line of seven\nown last line of seven", 46) in left and (2, None, None) in left and not any(x[0] == 8 for x in left)
    assert line_dedup.dedup_lines(none).count() == 0


def test_texts_are_merged_whatever_their_size(spark):
    docs = spark.createDataFrame([(i, "a b c d\ne f g h\ni j k l") for i in range(3)], "doc_id long, text string")
    for rows in (line_dedup.dedup_lines(docs), line_dedup.without_repeated_lines(docs)):
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_windows_meet_their_hashes_in_turns(spark, monkeypatch):
    """No shuffle holds the windows of all hashes."""
    sizes, plain = [], line_dedup.settled

    def seen(rows, name):
        found = plain(rows, name)
        if name == "repeated-windows":
            sizes.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "settled", seen)
    text = "\n".join(f"one two three four {i}" for i in range(202))
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    removed = {r["doc_id"]: r["_n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert removed == {0: 0, 1: 202, 2: 202}
    assert sum(sizes) == 600 and max(sizes) < 450


def test_long_lines_are_cut_at_sentences(spark):
    passage = " ".join(f"Sentence {i} has just seven words here." for i in range(12))
    docs = spark.createDataFrame([(1, passage), (2, f"Something else. {passage} And an end.")], "doc_id long, text string")
    got = {r["doc_id"]: r["_kept"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: passage, 2: "Something else. And an end."}


def test_windows_that_overlap_themselves(spark):
    line = "the very same line again and again"
    docs = spark.createDataFrame([(1, "\n".join([line] * 6 + ["another line of some words"]))], "doc_id long, text string")
    (row,) = line_dedup.dedup_lines(docs).collect()
    assert row["_kept"] == f"{line}\nanother line of some words"


def test_long_passages_of_few_units_are_removed(spark):
    def prose(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))

    passages = {
        "one sentence": prose(1, 60),
        "two sentences": f"{prose(2, 30)}. {prose(3, 30)}.",
        "two lines": f"{prose(4, 30)}\n{prose(5, 30)}",
        "tabs": prose(6, 60).replace(" ", "\t"),
    }
    for name, passage in passages.items():
        around = [(i, f"{prose(100 + i, 9)}.\n", f"\n{prose(200 + i, 9)}.") for i in range(4)]
        # And within a line: its ends may stay, but not what lies more than two cuts inside.
        around += [(i, f"{prose(300 + i, 20)} ", f" {prose(400 + i, 20)}") for i in range(4, 8)]
        docs = spark.createDataFrame([(i, a + passage + b) for i, a, b in around], "doc_id long, text string")
        got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs).collect()}
        assert got[0] == around[0][1] + passage + around[0][2], name
        for i, a, b in around[1:]:
            if i < 4:
                assert got[i] == a + b.strip("\n"), name
            else:
                words = passage.split()
                assert got[i].startswith(a) and got[i].endswith(b.strip()), name
                assert not set(words[14:-14]) & set(got[i].split()) - set(words[:14] + words[-14:] + a.split() + b.split()), name


def test_long_passages_of_short_units_are_removed(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("ABCDEFGHIJ", k=5)) for _ in range(150)]
    for passage in (" ".join(f"{w}!!" for w in words), "\n".join(words[:60]), "\n".join(f"{a} {b}" for a, b in zip(words[:40:2], words[1:40:2], strict=True))):
        docs = spark.createDataFrame([(i, f"own line {i} at the top\n{passage}\nown line {i} below") for i in range(3)], "doc_id long, text string")
        got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs).collect()}
        assert got == {0: f"own line 0 at the top\n{passage}\nown line 0 below", **{i: f"own line {i} at the top\nown line {i} below" for i in (1, 2)}}
    # Three short lines with fewer than eight words in all stay.
    docs = spark.createDataFrame([(i, f"own line {i} at the top\nyes\nno\nyes then\nown line {i} below") for i in range(3)], "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in line_dedup.without_repeated_lines(docs).collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}


def test_pieces_hold_the_whole_text_and_few_words(spark, odd):
    docs = odd.where("text is not null").select("text", line_dedup.pieces().alias("p")).collect()
    for r in docs:
        lines = {}
        for p in r["p"]:
            lines.setdefault(p["line"], []).append(p["unit"])
            assert len(p["unit"].split()) <= line_dedup.CUT
        assert "\n".join("".join(x) for x in lines.values()) == r["text"]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_match(text, items):
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for item, item_text in items:
        own = WORD.findall(low(item_text))
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    for trial in range(150):
        def some(most):
            return " ".join(rng.choice("abcd") for _ in range(rng.randint(0, most)))

        items = [(rng.randint(0, 5), some(rng.choice([2, 6, 30]))) for _ in range(rng.randint(0, 6))]
        tool = decontamination.Automaton([(str(i), decontamination.words(t)) for i, t in items], window=5)
        text = some(60)
        spans, found, longest = tool.match(decontamination.words(text))
        words = text.split()
        hit, want, most = set(), set(), 0
        for item, item_text in items:
            own = item_text.split()
            n = min(5, len(own))
            for i in range(len(words)):
                for k in range(len(own)):
                    run = 0
                    while i + run < len(words) and k + run < len(own) and words[i + run] == own[k + run]:
                        run += 1
                    most = max(most, run)
                    if n and run >= n:
                        hit |= set(range(i, i + n))
                        want.add(str(item))
        assert {p for a, b in spans for p in range(a, b)} == hit and found == want, (trial, items, text)
        assert longest == most or most < tool.least  # shorter stretches are not looked at


def test_decontamination_of_odd_rows(spark, odd, none):
    item = " ".join(f"word{i}" for i in range(100, 120))
    bench = [(1, item), (2, None), (3, ""), (4, "lazy DOG"), (5, item), (None, "quick brown"), (1, item)]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    docs = odd.select("doc_id", "text")
    want = Counter((d, *plain_match(t, bench)[:2], ",".join(plain_match(t, bench)[2])) for d, t, *_ in ROWS)
    for most_words in (200_000, 15):  # one automaton, several
        got = decontamination.match_items(docs, benchmark, most_words=most_words).withColumn("n_hit", decontamination.n_hit())
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got.collect()) == want
    kept = decontamination.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns
    left = {r["doc_id"]: r for r in kept.collect()}
    assert 1 not in left and 5 in left and left[5]["n_chars"] == len(left[5]["text"]) < ROWS[4][4]
    assert item not in left[5]["text"]
    assert decontamination.match_items(none.select("doc_id", "text"), benchmark).count() == 0
    assert decontamination.decontaminate(odd, benchmark.limit(0)).count() == len(ROWS)


def test_decontamination_query_hashes_items(spark, texts):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = decontamination.op6_decontamination(spark, SF).collect()
    for r in got:
        n, hit, found = plain_match(texts[r["doc_id"]], bench)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_texts_are_cut_once(spark, table):
    """The optimizer copies columns into filters and lambdas; what cuts a text stands once in the plan all the same."""
    kept = line_dedup.without_repeated_lines(table).where("n_chars > 10 AND length(text) > 5")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?][ ") == 1
