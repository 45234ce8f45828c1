"""Merkle manifest of a dataset: a tree per group, a tree of the groups, and a proof for every row.

Rows of a group stand in the order of their id. On every level, ``FANOUT`` nodes in a row are a run, whose hash is the node
above. Siblings come from lag and lead columns of fixed offsets 1 to ``FANOUT - 1``, masked by a node's slot in its run
and by the length of the run; the row of the first child hashes the parent and goes on to the next level. A last run may be
short, and a node alone in its run is hashed too. A group of one row has no level: its leaf is its subroot.

Nothing is gathered: positions come from a range sort and counts by its partitions, windows are over blocks of
``BLOCK`` positions of one group, so a group of any size spreads over many tasks. Each level is an eighth of the one below
and is written, so the loop has as many rounds as the tree has levels. Paths are put together from the top down, once for
every run of leaves, and meet the rows by the number of their run; the rows themselves carry digests only, never texts.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlens.llm.common import documents, settled

FANOUT = 8
# Four levels of positions: the widest window.
BLOCK = FANOUT**4
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3
_PATH = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(values: Sequence[Column]) -> Column:
    """The hash of a row: ``-`` for null, else the number of UTF-8 bytes, a colon and the value, one after the other."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)))


def group_key(group: Column) -> Column:
    """A group as a string that is never null and sorts nulls first, then by UTF-8 bytes."""
    return F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group.cast("string")))


def _positioned(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows with ``pos`` from 0 within their ``tree`` and its ``size``, by a range sort and the sizes of its partitions."""
    # Rows alike in all that is sorted by may be very many; the last column lets them spread.
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange("tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie").drop("_tie")
    placed = settled(ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    # At most as many rows as partitions and trees together.
    counts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by_part = Window.partitionBy("tree").orderBy("part")
    before = F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = counts.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), total.alias("size"))
    joined = placed.join(offsets, ["tree", "part"])
    return joined.select(*rows.columns, (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "size")


def with_siblings(nodes: DataFrame, by: str) -> DataFrame:
    """Adds ``left`` and ``right``, the joined digests of a node's siblings in its run, for nodes (tree, pos, size, digest).

    ``by`` is a column of the position divided by ``FANOUT`` or a power of it; windows are over its values.
    """
    slot = F.col("pos") % FANOUT
    run_length = F.least(F.lit(FANOUT), F.col("size") - F.col("pos") + slot)
    near = Window.partitionBy("tree", by).orderBy("pos")
    left = [F.when(slot >= k, F.lag("digest", k).over(near)) for k in range(FANOUT - 1, 0, -1)]
    right = [F.when(slot + k < run_length, F.lead("digest", k).over(near)) for k in range(1, FANOUT)]
    return nodes.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)})


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return with_siblings(nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)), "block").drop("block")


def _levels(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written levels above the leaves (tree, pos, left, right) up to the roots' children, and the roots (tree, digest)."""
    nodes = leaves.select("tree", "pos", "size", "digest")
    roots, levels = nodes.where("size = 1"), []
    most = nodes.agg(F.max("size")).first()[0] or 0
    hashed = _in_blocks(nodes)
    while most > 1:
        firsts = hashed.where((F.col("size") > 1) & (F.col("pos") % FANOUT == 0))
        parents = firsts.select(
            "tree",
            F.floor(F.col("pos") / FANOUT).alias("pos"),
            F.ceil(F.col("size") / FANOUT).alias("size"),
            digest(F.concat("digest", "right")).alias("digest"),
        )
        hashed = settled(_in_blocks(parents), "merkle-level")
        roots = roots.unionByName(hashed.where("size = 1").select(*roots.columns))
        most = -(-most // FANOUT)
        if most > 1:
            levels.append(hashed.where("size > 1").select("tree", "pos", "left", "right"))
    return levels, roots.select("tree", "digest")


def _paths(levels: list[DataFrame]) -> DataFrame | None:
    """(tree, run, upper) for every node of the lowest of these levels, at position ``run``: the siblings from it up."""
    paths = None
    for level in reversed(levels):
        own = level.select("tree", F.col("pos").alias("run"), F.array(F.struct("left", "right")).cast(_PATH).alias("own"))
        if paths is None:
            paths = own.withColumnRenamed("own", "upper")
            continue
        above = paths.withColumnRenamed("run", "above")
        joined = own.withColumn("above", F.floor(F.col("run") / FANOUT)).join(above, ["tree", "above"], "left")
        paths = joined.select("tree", "run", F.concat("own", F.coalesce("upper", F.array().cast(_PATH))).alias("upper"))
    return paths


def _proven(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Positioned ``leaves`` with ``path``, up to the root of their tree."""
    # Windows over single runs here, as the paths from above are joined by run: one shuffle serves both.
    rows = with_siblings(leaves.withColumn("run", F.floor(F.col("pos") / FANOUT)), "run")
    none = F.array().cast(_PATH)
    path = F.when(F.col("size") > 1, F.array(F.struct("left", "right")).cast(_PATH)).otherwise(none)
    paths = _paths(levels)
    if paths is not None:
        rows = rows.join(paths, ["tree", "run"], "left")
        path = F.concat(path, F.coalesce("upper", none))
    return rows.select(*leaves.columns, path.alias("path"))


def prove(rows: DataFrame, group_col: str = "lang", id_col: str = "doc_id", leaf_col: str = "leaf") -> DataFrame:
    """Per row: ``row`` (all its columns, as a struct), ``subroot``, ``root`` and ``path``, the siblings (left, right) level by level.

    Groups are ordered by their UTF-8 bytes, null first, and a null group is a group. Rows without an id come first in
    theirs; rows of one id are ordered by their leaf, and rows alike in both give the same tree in any order. A leaf must
    not be null. An empty table gives no row.
    """
    keyed = rows.select(
        group_key(F.col(group_col)).alias("tree"), F.col(id_col).alias("id"), F.col(leaf_col).alias("digest"),
        F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"),
    )
    ordered = _positioned(keyed, ["id", "digest"], "merkle-leaves")
    levels, subroots = _levels(ordered)
    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    tops = _positioned(groups, ["group"], "merkle-groups")
    top_levels, root = _levels(tops)
    # One row per group.
    of_group = _proven(tops, top_levels).join(root.select("tree", F.col("digest").alias("root")), "tree")
    of_group = settled(of_group.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("path").alias("top")), "merkle-roots")
    proven = _proven(ordered, levels).join(of_group, "tree")
    return proven.select("row", "subroot", "root", F.concat("path", "top").alias("path"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, start, lambda node, p: digest(F.concat(p["left"], node, p["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, its roots, the hash of its proof, and whether a partly tampered copy still folds to the root.

    Null ids are not tampered with; lower-casing touches the text only, so a text without capitals stays verified.
    """
    docs = documents(spark, sf_dir)
    values = {c: F.col(c) for c in HASHED}
    tampered = {**values, "text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))
    own = leaf(list(values.values()))
    # Texts are read and hashed once.
    leaves = docs.select("doc_id", "lang", own.alias("leaf"), F.when(chosen, leaf(list(tampered.values()))).otherwise(own).alias("claimed"))
    proven = prove(settled(leaves, "merkle-digests")).withColumn("folded_root", fold(F.col("row.claimed"), F.col("path")))
    return proven.select(
        "row.doc_id", "row.leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql(levels: int = 9, top_levels: int = 4) -> str:
    """The manifest in SQL, for trees of up to eight to the power of ``levels`` leaves."""
    value = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
    translated = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    plain = " || ".join(value.format(c) for c in HASHED)
    changed = " || ".join(value.format(translated if c == "text" else c) for c in HASHED)
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1),"
        " lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],"
        " lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
    )
    parts = [
        f"""leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, sha256({plain}) AS leaf,
         CASE WHEN coalesce({crc} % 3 = 0, false) THEN sha256({changed}) ELSE sha256({plain}) END AS claimed
  FROM documents)""",
        """a0 AS (
  SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS size
  FROM leaves)""",
    ]

    def tree(prefix: str, count: int) -> None:
        for k in range(count):
            near = "OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
            parts.append(
                f"""{prefix}s{k} AS (
  SELECT tree, pos, size > 1 AS is_level,
         coalesce(string_agg(digest, '') {near} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') {near} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {prefix}{k})"""
            )
            parts.append(
                f"""{prefix}{k + 1} AS (
  SELECT tree, pos // 8 AS pos, (size + 7) // 8 AS size,
         CASE WHEN size = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
  FROM {prefix}{k} GROUP BY tree, pos // 8, size)"""
            )

    tree("a", levels)
    parts.append(
        f"""b0 AS (
  SELECT '' AS tree, tree AS own, digest AS subroot, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size
  FROM a{levels})"""
    )
    tree("b", top_levels)
    steps = [("a", k) for k in range(levels)] + [("b", k) for k in range(top_levels)]
    folded = ["claimed AS f0"]
    parts.append(
        "joined AS (\n  SELECT a0.doc_id, a0.leaf, a0.claimed, b0.subroot, root.digest AS root"
        + "".join(f",\n         {p}s{k}.is_level AS {p}v{k}, {p}s{k}.l AS {p}l{k}, {p}s{k}.r AS {p}r{k}" for p, k in steps)
        + f"\n  FROM a0 JOIN b0 ON b0.own = a0.tree CROSS JOIN b{top_levels} AS root"
        + "".join(
            f"\n  JOIN {p}s{k} ON {p}s{k}.tree = {p}0.tree AND {p}s{k}.pos = {p}0.pos // {8**k}" for p, k in steps
        )
        + ")"
    )
    last = "joined"
    for i, (p, k) in enumerate(steps):
        f = "claimed" if i == 0 else f"f{i}"
        parts.append(f"g{i} AS (SELECT *, CASE WHEN {p}v{k} THEN sha256({p}l{k} || {f} || {p}r{k}) ELSE {f} END AS f{i + 1} FROM {last})")
        last = f"g{i}"
    proof = " || ".join(f"CASE WHEN {p}v{k} THEN {p}l{k} || {p}r{k} ELSE '' END" for p, k in steps)
    return (
        "WITH " + ",\n".join(parts)
        + f"\nSELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{len(steps)} AS folded_root, f{len(steps)} = root AS verified\nFROM {last}"
    )


ORACLE = _sql()
