"""SimHash near-duplicates by a self-join of binary tries.

Two 64-bit fingerprints with at most three differing bits agree in at least one of four 16-bit blocks. Each fingerprint
therefore goes, once for each block, to the trie of the fingerprints with that block, rotated so that the block comes
first and is the root's path. In a trie, node pairs are walked together from the root: differing bits add up on the way
down, and a pair is dropped once they exceed the budget. Tries lie as sorted arrays, a node is a range of one, so a walk
takes whole arrays of node pairs at a time. Small node pairs are settled by comparing their leaves. A pair whose leaves
already hang together is dropped too, so a ball of very many near fingerprints gives a spanning tree, not all its pairs.

A node pair with more than ``most_leaves`` leaves is first split, in Spark, into the pairs of its descendants six levels
down that are within budget, again and again while one is too large; so no task holds a larger trie.

Only equal fingerprints are joined by their value; their documents are never paired. Components of the links come from
large-star / small-star rounds on tables in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, id_and_text, joined_by, set_aside, settled

SEED = 42
SHINGLE = 3
MOST_BITS = 3
BLOCK = 16
SPLIT_BITS = 6
MOST_LEAVES = 50_000
_CHUNK = 50_000
_AT_ONCE = 20_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text; 0 for a text without words. Shingles are hashed in pieces, so memory stays bounded."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _AT_ONCE):
        part = words[i : i + _AT_ONCE + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(part)]
        hashes = np.array([digest(s, SEED) for s in joined], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as a signed long and a hash of the text, per row of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _compress(labels: np.ndarray) -> np.ndarray:
    while True:
        further = labels[labels]
        if np.array_equal(further, labels):
            return labels
        labels = further


def _unite(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (smallest index of a component) after the links are added."""
    while len(left):
        a, b = labels[left], labels[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        labels = _compress(labels)
    return labels


def join_tries(values: np.ndarray, pairs: list[tuple[int, int, int, int, int, int]], most_bits: int = MOST_BITS) -> np.ndarray:
    """Component labels of the leaves ``values`` by links within the node pairs.

    A pair is (start, end, start, end, differing bits so far, depth), ranges of ``values`` that are sorted in themselves;
    equal ranges are a node with itself.
    """
    values = values.astype(np.uint64)
    labels = np.arange(len(values))
    ones: dict[int, np.ndarray] = {}
    stack = []
    table = np.array(pairs, np.int64).reshape(-1, 6)
    for depth in np.unique(table[:, 5]):
        part = table[table[:, 5] == depth, :5]
        stack += [(int(depth), part[i : i + _CHUNK]) for i in range(0, len(part), _CHUNK)]

    def split(start, end, depth):
        if depth not in ones:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], bit.astype(np.int32).cumsum()])
        return end - (ones[depth][end] - ones[depth][start])

    while stack:
        depth, pair = stack.pop()
        # Pairs whose leaves already hang together.
        changes = np.concatenate([[0], (labels[1:] != labels[:-1]).cumsum()])
        a, b, c, d, bits = pair.T
        joined = (changes[b - 1] == changes[a]) & (changes[d - 1] == changes[c]) & (labels[a] == labels[c])
        pair = pair[~joined]
        a, b, c, d, bits = pair.T
        small = ((b - a) * (d - c) <= 36) | (depth == 64)
        if small.any():
            a, b, c, d, _ = pair[small].T
            n = (b - a) * (d - c)
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            i, j = a[which] + k // (d - c)[which], c[which] + k % (d - c)[which]
            keep = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= most_bits)
            labels = _unite(labels, i[keep], j[keep])
        a, b, c, d, bits = pair[~small].T
        if not len(a):
            continue
        m, o = split(a, b, depth), split(c, d, depth)
        same = a == c
        children = np.concatenate(
            [
                np.stack([a, m, o, d, bits + 1], 1),
                np.stack([m, b, c, o, bits + 1], 1)[~same],
                np.stack([a, m, c, o, bits], 1),
                np.stack([m, b, o, d, bits], 1),
            ]
        )
        children = children[(children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= most_bits)]
        stack += [(depth + 1, children[i : i + _CHUNK]) for i in range(0, len(children), _CHUNK)]
    return labels


def _rotate(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return np.where(by == 0, values, (values << by) | (values >> ((np.uint64(64) - by) & np.uint64(63))))


_NODES = "turn int, a long, b long, depth int, bits int, side int, value long"
_NODE = ["turn", "a", "b", "depth"]


def _split_nodes(frames):
    """Rows of node pairs, dealt to the pairs of descendants SPLIT_BITS lower that are within budget."""
    codes = np.arange(1 << SPLIT_BITS, dtype=np.int64)
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :]).astype(np.int64)
    for frame in frames:
        depth = frame["depth"].to_numpy()
        step = np.minimum(SPLIT_BITS, 64 - depth)
        value = frame["value"].to_numpy().view(np.uint64)
        code = ((value >> (64 - depth - step).astype(np.uint64)) & ((1 << step) - 1).astype(np.uint64)).astype(np.int64)
        bits = frame["bits"].to_numpy()[:, None] + apart[code]
        rows, other = np.nonzero((bits <= MOST_BITS) & (codes[None, :] < (1 << step)[:, None]))
        a, b, side = (frame[x].to_numpy()[rows] for x in ("a", "b", "side"))
        own, step_ = code[rows], step[rows]
        both = side == 2
        right = np.where(both, own > other, side == 1)
        yield pd.DataFrame(
            {
                "turn": frame["turn"].to_numpy()[rows],
                "a": (a << step_) | np.where(right, other, own),
                "b": (b << step_) | np.where(right, own, other),
                "depth": (depth[rows] + step_).astype("i4"),
                "bits": bits[rows, other].astype("i4"),
                "side": np.where(both & (own == other), 2, right).astype("i4"),
                "value": frame["value"].to_numpy()[rows],
            }
        )


def _join_nodes(frames):
    """Links (fingerprint, smaller one of its component) of rows that come ordered by node pair."""

    def walk(frame):
        frame = frame.sort_values(["turn", "a", "b", "depth", "side"], kind="stable")
        value = frame["value"].to_numpy().view(np.uint64)
        group = (frame[_NODE].diff().fillna(1) != 0).any(axis=1).cumsum().to_numpy()
        order = np.lexsort((value, frame["side"].to_numpy(), group))
        value, group = value[order], group[order]
        side, depth, bits, turn = (frame[x].to_numpy()[order] for x in ("side", "depth", "bits", "turn"))
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(starts[1:], len(group))
        rights = np.add.reduceat(side == 1, starts) if len(starts) else starts
        self_ = side[starts] == 2
        middle = np.where(self_, starts, ends - rights)
        first_end = np.where(self_, ends, middle)
        pairs = np.stack([starts, first_end, middle, ends, bits[starts], depth[starts]], 1)
        pairs = pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (ends - starts > 1)]
        labels = join_tries(value, pairs)
        plain = _rotate(value, (64 - BLOCK * turn) % 64).view(np.int64)
        linked = labels != np.arange(len(labels))
        return pd.DataFrame({"u": plain[linked], "v": plain[labels[linked]]})

    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = (frame[_NODE] == frame[_NODE].iloc[-1]).all(axis=1).to_numpy() if len(frame) else np.zeros(0, bool)
        start = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if start:
            yield walk(frame.iloc[:start])
        held = frame.iloc[start:]
    if held is not None and len(held):
        yield walk(held)


def links(distinct: DataFrame, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """A spanning set (u, v) of the links between distinct fingerprints ``fp``."""
    turn = F.explode(F.array(*(F.lit(i) for i in range(64 // BLOCK)))).alias("turn")
    rotated = F.when(F.col("turn") == 0, F.col("fp")).otherwise(
        F.expr(f"shiftleft(fp, {BLOCK} * turn) | shiftrightunsigned(fp, 64 - {BLOCK} * turn)")
    )
    top = F.expr(f"shiftrightunsigned(value, {64 - BLOCK})")
    fixed = {"depth": BLOCK, "bits": 0, "side": 2}
    nodes = distinct.select("fp", turn).select("turn", rotated.alias("value")).withColumns({"a": top, "b": top, **{k: F.lit(v) for k, v in fixed.items()}})
    nodes = nodes.select(*[c.split()[0] for c in _NODES.split(", ")])
    ready = []
    while True:
        large = nodes.groupBy(*_NODE).count().where(F.col("count") > most_leaves).select(*_NODE)
        large = settled(large, "simhash-large")
        if large.isEmpty():
            ready.append(nodes)
            break
        # At most one row for every ``most_leaves`` rows of nodes.
        ready.append(nodes.join(large, _NODE, "left_anti").select(*nodes.columns))
        nodes = settled(nodes.join(large, _NODE, "left_semi").select(*nodes.columns).mapInPandas(_split_nodes, _NODES), "simhash-nodes")
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.union(more)
    return rows.repartition(*_NODE).sortWithinPartitions(*_NODE).mapInPandas(_join_nodes, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of the undirected edges (u, v); root: the component's smallest vertex.

    Rounds of large-star and small-star, until the edges are stars and stay as they are. Every round is a table.
    """

    def mark(rows):
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    was = mark(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settled(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settled(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = mark(edges)
        if now == was:
            break
        was = now
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash, fp, component (its smallest fingerprint) and component_id (its smallest id).

    A null text counts as empty; all texts without words share the fingerprint 0. A row without an id gets the smallest
    id of its component, null if no row of it has one. An empty table gives no row.
    """
    rows = settled(fingerprints(id_and_text(docs, id_col, text_col)), "fingerprints")
    distinct = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct-fingerprints")
    found = settled(components(links(distinct)), "components")
    linked = found.join(distinct, found["vertex"] == distinct["fp"]).select("root", "fp", "least_id")
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_linked = linked.join(ids, "root").select(F.col("fp").alias("linked"), "root", "component_id")
    named = distinct.join(of_linked, F.col("fp") == F.col("linked"), "left").select(
        "fp",
        "n",
        F.coalesce("root", "fp").alias("component"),
        F.when(F.col("linked").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    found = joined_by(rows, settled(named, "named-fingerprints"), "fp")
    return found.select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component: the one of the smallest id.

    Rows of one id and text are one document, of which any one row stays, also where their other columns differ. Of a
    component without any id, one document stays. An empty table gives no row.
    """

    def key(doc_id, text_hash):
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), text_hash.cast("string"))

    docs, back = set_aside(docs, id_col, text_col)
    found = near_duplicates(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    kept = found.groupBy("component").agg(F.min(order).alias("first"))
    keys = kept.select(key(F.col("first.doc_id"), F.col("first.text_hash")).alias("_kept_key")).distinct()
    own = key(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return back(docs.withColumn("_kept_key", own).join(keys, "_kept_key").dropDuplicates(["_kept_key"]))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id of its component."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
