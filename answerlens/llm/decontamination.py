"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton holds every run of words of every item. A document's words go through it one by one; its state knows the
longest run that ends at the word, so a match of ``window`` words or more, or of a whole shorter item, marks the words it
covers. A run of document words that no item has cannot be left inside a match, so only stretches of item words that are
long enough enter the automaton.

Items are dealt to automata of at most ``most_words`` words (an item is never cut), each item's own windows with it. With
one automaton, the usual case, documents are neither shuffled nor written; with more, each passes over all documents and
the marked spans are brought together per document. So neither broadcast nor automaton grows with the benchmark.
"""

from __future__ import annotations

import hashlib
import re
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, id_and_text, set_aside, settled

WINDOW = 13
MOST_SHARE = Decimal("0.05")
MOST_WORDS = 200_000

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_KEPT = set(_LETTERS + _LETTERS.upper() + b"0123456789") | set(range(128, 256))
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEPT else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and other characters from U+0080 on, with A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


class _Vocabulary(dict):
    def __missing__(self, key):
        return 0


class Automaton:
    """Generalised suffix automaton over word ids; items are (label, words)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary = _Vocabulary()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [0], [0]
        labels: list[set] = [set()]
        shorts: list[list] = [[]]
        self.least = window
        for label, text in items:
            if not text:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text]
            last = 0
            for i in ids:
                last = self._extend(last, i)
                while len(labels) < len(self.link):
                    labels.append(set())
                    shorts.append([])
                labels[last].add(label)
            if len(ids) < window:
                self.least = min(self.least, len(ids))
                shorts[last].append((len(ids), label))
        # From long states to short ones: a state's items are also those of the states that end in its words.
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.length[self.link[state]] >= window:
                labels[self.link[state]] |= labels[state]
        self.labels = labels
        self.base = [0] * len(self.link)
        self.shorts: list[tuple] = [()] * len(self.link)
        for state in order:
            up = self.link[state]
            self.base[state] = self.base[up] if self.length[up] >= window else state
            # A short item ends in the state whose longest run it may not be; the runs of its suffix links are shorter.
            self.shorts[state] = (*shorts[state], *self.shorts[up])

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, word, q)
        new = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while word not in nxt[p]:
            nxt[p][word] = new
            if p == 0:
                return new
            p = link[p]
        q = nxt[p][word]
        link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while nxt[p].get(word) == q:
            nxt[p][word] = clone
            if p == 0:
                break
            p = link[p]
        return clone

    def match(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Marked spans of word positions (start, end), merged; the labels of items found; the longest run
        matched, which counts only from the length of the shortest window on."""
        if not self.vocabulary or len(text) < self.least:
            return [], set(), 0
        ids = np.fromiter(map(self.vocabulary.__getitem__, text), np.int32, len(text))
        edges = np.flatnonzero(np.diff(ids != 0, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        keep = ends - starts >= self.least
        spans, states, found, longest = [], set(), set(), 0
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for start, end in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            state, run = 0, 0
            for at, word in enumerate(ids[start:end].tolist(), start):
                to = nxt[state].get(word)
                while to is None:
                    state = link[state]
                    run = length[state]
                    to = nxt[state].get(word)
                state, run = to, run + 1
                if run >= window:
                    states.add(self.base[state])
                    spans.append((at + 1 - window, at + 1))
                if run > longest:
                    longest = run
                for n, label in self.shorts[state]:
                    if n <= run:
                        found.add(label)
                        spans.append((at + 1 - n, at + 1))
        for state in states:
            found |= self.labels[state]
        return merged(spans), found, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


_SPANS = "array<struct<start:int,end:int>>"
_MATCHED = f"n_words long, spans {_SPANS}, items array<string>, longest int"
_ARROW = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_AUTOMATA: dict[bytes, Automaton] = {}


def _automaton(key: bytes, items: list, window: int) -> Automaton:
    """The automaton of this worker process, built once from the broadcast items."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton([(label, words(text)) for label, text in items], window)
    return _AUTOMATA[key]


def item_chunks(benchmark: DataFrame, most_words: int, id_col: str, text_col: str):
    """Yield lists of (item id as text, text), of about ``most_words`` words each; one list is on the driver at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = items.where(F.col("text") != "").distinct()
    size = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    chunk = F.lit(0)
    n = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // most_words))
    chunks = [0]
    while n > 1:
        chunk = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        sizes = items.groupBy(chunk.alias("chunk")).agg(F.sum(size).alias("n"), F.count("*").alias("items")).collect()
        chunks = sorted(r["chunk"] for r in sizes)
        # A chunk of one item is as small as it gets.
        if all(r["n"] <= most_words or r["items"] == 1 for r in sizes):
            break
        n *= 2
    for k in chunks:
        yield sorted(((r["item"], r["text"]) for r in items.where(chunk == k).collect()), key=repr)


def match_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS, carried: tuple[str, ...] = (), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text and the carried columns) with n_words, spans (of word positions), items and longest match.

    An item shorter than the window, but not empty, is a window as a whole. Spans of several automata are merged.
    """
    spark = docs.sparkSession
    if not carried:
        docs = docs.select("doc_id", "text")
    kept = [f for f in docs.schema.fields if f.name in ("doc_id", *carried)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), _MATCHED])

    def one_pass(items: list, rows: DataFrame, names: list[str], schema: str) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)
        key = hashlib.sha256(repr((items, window)).encode()).digest()

        def run(batches):
            for batch in batches:
                tool = _automaton(key, sent.value, window)
                n, spans, found, longest = [], [], [], []
                for text in batch.column("text"):
                    cut = words(text.as_py() or "")
                    s, labels, most = tool.match(cut)
                    n.append(len(cut))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    found.append(sorted(x for x in labels if x is not None))
                    longest.append(most)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(spans, pa.list_(_ARROW)), pa.array(found, pa.list_(pa.string())), pa.array(longest, pa.int32())],
                    [*names, "n_words", "spans", "items", "longest"],
                )

        return rows.mapInArrow(run, schema)

    chunks = item_chunks(benchmark, most_words, item_id, item_text)
    first, second = next(chunks), next(chunks, None)
    if second is None:
        return one_pass(first, docs, [f.name for f in kept], schema)
    # Several automata: rows are known by id and text hash; rows of one id and text have equal matches.
    keyed = docs.withColumns({"_match_id": F.col("doc_id"), "_match_hash": F.xxhash64("text")})
    names = ["_match_id", "_match_hash"]
    texts = keyed.select(*names, "text")
    passes = None
    for items in (first, second, *chunks):
        part = settled(one_pass(items, texts, names, f"_match_id long, _match_hash long, {_MATCHED}"), "matches")
        passes = part if passes is None else passes.unionByName(part)
    spans = F.array_sort(F.flatten(F.collect_set("spans")))
    joined = passes.groupBy(*names).agg(
        F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("longest").alias("longest")
    )
    joined = joined.withColumn("spans", _merged_spans(F.col("spans")))
    left, right = keyed.alias("l"), joined.alias("r")
    same = F.col("l._match_id").eqNullSafe(F.col("r._match_id")) & (F.col("l._match_hash") == F.col("r._match_hash"))
    return left.join(right, same).select(*(F.col(f"l.`{f.name}`") for f in kept), "n_words", "spans", "items", "longest")


def _merged_spans(spans: Column) -> Column:
    """Sorted spans, with those that touch brought together."""

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")))
        )
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]), joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast(_SPANS), add)


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(most_share: Decimal = MOST_SHARE) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(most_share) * F.col("n_words"))


def without_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The text without the characters from the first to the last word of each span."""

    def cut(text, marked):
        if marked is None or not len(marked):
            return text
        places = [m.span() for m in _WORD.finditer(text)]
        out, at = [], 0
        for s in marked:
            out.append(text[at : places[s["start"]][0]])
            at = places[s["end"] - 1][1]
        return "".join([*out, text[at:]])

    return pd.Series([cut(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_share: Decimal = MOST_SHARE, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns: a document goes if matches cover ``most_share`` of its words or more; of the
    others, the marked spans are cut out of the text and ``n_chars``, where there is one, counts anew.

    A null text has no words, stays and stays null. Repeated rows are each treated alike and all stay or go. An empty
    table gives no row; without items all rows stay as they are.
    """
    docs, back = set_aside(docs, "doc_id", "text", "n_chars")
    matched = match_items(docs, benchmark, window, most_words, carried=tuple(docs.columns))
    kept = matched.withColumn("n_hit", n_hit()).where(~contaminated(most_share))
    hit = F.size("spans") > 0
    cut_out = F.pandas_udf(without_words, "string")
    kept = kept.withColumn("_cut", F.when(hit, cut_out(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    new = {"text": F.col("_cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("_cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return back(kept.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of words inside benchmark windows, and the items found."""
    found = match_items(id_and_text(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.withColumn("n_hit", n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


# Windows by hash-free equality of word arrays: 13 consecutive words of an item, or all words of a shorter one.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), m AS (
  SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n
), hits AS (
  SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS h FROM m) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
