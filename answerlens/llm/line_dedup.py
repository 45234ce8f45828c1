"""Line dedup by overlapping windows of three lines. DataFrame and SQL functions only.

A unit is a line; a line of more than ``LONG_LINE`` words is cut at its sentence ends into several, so that a passage
written as one long line is found as well. Every three consecutive units of a document with ``MIN_WORDS`` words together
are a window, known by its hash. The first occurrence of a window, by document id, stays; the units that later
occurrences cover are merged into ranges and removed.

That is the rule of ``op3_line_dedup``, which its SQL states. It misses a passage of over ``LONG_LINE`` words that has fewer
than three units of its own. The stage of the pipeline therefore works on ``pieces``: lines are cut at every sentence end,
and sentences after the word of the smallest hash of every ``CUT`` words in a row. These places depend on the nearest words
only, and no piece has more than ``CUT`` words. Of a passage, the first and last ``CUT - 1`` words may be cut otherwise than
elsewhere, and what lies between them holds at least three whole pieces if the passage has over ``LONG_LINE`` words.

Texts are cut once: two hashes a window are written, 16 bytes for some 25 of text. Windows are counted by the first,
combined before the shuffle. Only windows whose hash occurs again go on, found in ``PASSES`` turns by hash; the most frequent hashes are known, a thousand at
most, and find their windows by broadcast. First occurrences are a minimum, combined before the shuffle, and found again by their place.
A document's own ranges are the only thing gathered, so the largest group is one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, joined_by, release, settled

LONG_LINE = 50
MIN_WORDS = 8
SPAN = 3
CUT = 8
# What is sure to be found of a passage of over LONG_LINE words, wherever it begins and ends.
SURE_WORDS = LONG_LINE + 1 - 2 * (2 * CUT - 1)
_PLACE = (1 << 24) - 1
# Windows meet the repeated hashes in so many turns, a share of the hashes each: all of them in one shuffle would be the most
# that is ever on disk.
PASSES = 2


def lines(text: str = "text") -> Column:
    """Units of every line: array of arrays."""
    return F.transform(
        F.split(F.col(text), "\n"),
        lambda line: F.when(F.size(F.split(line, " ")) > LONG_LINE, F.split(line, "(?<=[.!?]) ")).otherwise(F.array(line)),
    )


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _cut(sentence: Column) -> Column:
    """A sentence in parts of at most ``CUT`` words, blanks included, cut after the smallest hash (the last of equal ones) of every ``CUT`` words."""

    def parts(tokens):
        hashes = F.transform(tokens, lambda t, i: F.xxhash64(F.rtrim(t, F.lit(" \t\r"))).bitwiseAND(F.lit(~_PLACE)).bitwiseOR((F.lit(_PLACE) - i).cast("long")))
        # No slices here: each would copy the whole array, and a sentence may have any length.
        least = _let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - CUT), lambda j: F.least(*(F.get(h, j + k) for k in range(CUT)))))
        ends = F.transform(least, lambda x: (F.lit(_PLACE + 1) - x.bitwiseAND(F.lit(_PLACE))).cast("int"))
        bounds = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size(tokens))))
        return _let(bounds, lambda b: F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda q: part(tokens, F.get(b, q - 1), F.get(b, q))))

    def part(tokens, start, end):
        return F.concat_ws("", *(F.when(start + k < end, F.get(tokens, start + k)) for k in range(CUT)))

    tokens = F.split(sentence, r"(?<=[ \t\r])(?=[^ \t\r])")
    return _let(tokens, lambda t: F.when(F.size(t) < CUT, F.array(sentence)).otherwise(parts(t)))


def pieces(text: str = "text") -> Column:
    """Pieces of every line: (line, unit, first, last), the latter two for where a unit of ``lines`` begins and ends."""

    def of_unit(unit, i):
        parts = F.flatten(F.transform(F.split(unit, r"(?<=[.!?][ \t\r])"), _cut))
        return _let(
            parts,
            lambda p: F.transform(p, lambda x, k: F.struct(i.alias("line"), x.alias("unit"), (k == 0).alias("first"), (k == F.size(p) - 1).alias("last"))),
        )

    def of_line(line, i):
        units = F.when(F.size(F.split(line, " ")) > LONG_LINE, F.split(line, "(?<=[.!?] )")).otherwise(F.array(line))
        return F.flatten(F.transform(units, lambda unit: of_unit(unit, i)))

    return F.flatten(F.transform(F.split(F.col(text), "\n"), of_line))


def _n_words(unit: Column) -> Column:
    return F.regexp_count(unit, F.lit(r"[^ \t\r\n]+"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("own"))


def window_hashes(keyed: DataFrame, fine: bool = False) -> DataFrame:
    """(doc, own, hashes): per document the (hash, check) of the windows in order, null for one with too few words.

    ``fine``: windows of pieces, none of which is null, as ranges are judged when merged.
    """
    texts = F.transform(pieces(), lambda p: F.rtrim(p["unit"], F.lit(" \t\r"))) if fine else F.flatten(lines())

    def hashed(units: Column) -> Column:
        def window(i: Column) -> Column:
            parts = [F.get(units, i + k) for k in range(SPAN)]
            both = F.struct(F.xxhash64(*parts).alias("hash"), F.xxhash64(F.lit(1), *parts).alias("check"))
            return both if fine else F.when(sum((_n_words(p) for p in parts[1:]), _n_words(parts[0])) >= MIN_WORDS, both)

        return F.when(F.size(units) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(units) - SPAN), window))

    # Hashed within the row: the texts of windows, thrice those of the documents, are never rows.
    return keyed.select("doc", "own", _let(texts, hashed).alias("hashes"))


def later_occurrences(keyed: DataFrame, fine: bool = False) -> DataFrame:
    """Per document (doc, own) the sorted starts of windows that have occurred before."""
    hashed = settled(window_hashes(keyed, fine), "windows")
    hashes = hashed.select(F.explode("hashes").alias("w")).where("w IS NOT NULL")
    again = hashes.groupBy("w.hash").agg(F.count("*").alias("n")).where("n > 1")
    again = settled(again, "repeated-hashes")
    release(keyed.sparkSession)
    placed = hashed.select("doc", "own", F.posexplode("hashes").alias("at", "w")).where("w IS NOT NULL").select("doc", "own", "at", "w.*")
    parts = []
    for part in range(PASSES):
        mine = F.pmod("hash", F.lit(PASSES)) == part
        parts.append(settled(joined_by(placed.where(mine), again.where(mine), "hash"), "repeated-windows"))
        release(keyed.sparkSession)
    release(keyed.sparkSession, hashed, again)
    found = reduce(DataFrame.unionByName, parts)
    first = found.groupBy("hash", "check").agg(F.min(F.struct("doc", "own", "at")).alias("first")).select("first.*")
    # What is not first is later. Compared by place, so that a very frequent window does not meet itself in one task.
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("doc", "own", "at")]
    later = found.alias("w").join(first.alias("f"), same, "left_anti")
    # Written before the texts are shuffled, so that both need not be on disk at once.
    starts = settled(later.groupBy("doc", "own").agg(F.array_sort(F.collect_set("at")).alias("starts")), "later-windows")
    release(keyed.sparkSession, *parts)
    return starts


def _large_enough(units: Column) -> Column:
    """Whether a range of pieces is removed."""
    words = F.aggregate(units, F.lit(0), lambda n, u: n + _n_words(u["unit"]))
    ends = F.size(F.filter(units, lambda u: u["last"]))
    whole = ends - F.when(F.get(units, F.lit(0))["first"], 0).otherwise(1)
    return _let(words, lambda n: (n >= SURE_WORDS) | ((n >= MIN_WORDS) & (whole >= SPAN)))


def _ranges(starts: Column) -> Column:
    """Ranges (from, to) of covered units, where windows that touch are one range."""
    begins = F.filter(starts, lambda x, i: (i == 0) | (x > F.get(starts, i - 1) + SPAN))
    ends = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) > x + SPAN))
    return F.arrays_zip(begins.alias("from"), F.transform(ends, lambda x: x + SPAN).alias("to"))


def _part(units: Column, r: Column) -> Column:
    """The units of a range, one by one, as a slice would copy the whole array first."""
    places = F.when(r["from"] < r["to"], F.sequence(r["from"], r["to"] - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(units, i))


def _cleaned(units: Column, starts: Column, fine: bool) -> Column:
    """(n_lines, n_removed, kept) of units (line, unit, ...) and the starts of windows to remove.

    Every step is bound by ``_let``, so each is worked out once a document.
    """

    def joined(kept):
        parts = F.transform(
            kept,
            lambda x, i: F.concat(
                F.when(i == 0, "").when(F.get(kept, i - 1)["line"] == x["line"], "" if fine else " ").otherwise("\n"), x["unit"]
            ),
        )
        return F.array_join(parts, "")

    def result(u, ranges):
        gaps = F.arrays_zip(
            F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["to"])).alias("from"),
            F.concat(F.transform(ranges, lambda r: r["from"]), F.array(F.size(u))).alias("to"),
        )
        kept = F.flatten(F.transform(gaps, lambda g: _part(u, g)))
        return _let(
            kept,
            lambda k: F.struct(
                F.size(u).cast("long").alias("n_lines"), (F.size(u) - F.size(k)).cast("long").alias("n_removed"), joined(k).alias("kept")
            ),
        )

    def cleaned(u):
        ranges = _ranges(starts)
        if fine:
            ranges = F.filter(ranges, lambda r: _let(_part(u, r), _large_enough))
        return _let(ranges, lambda r: result(u, r))

    return _let(units, cleaned)


def _with_results(docs: DataFrame, id_col: str, text_col: str, fine: bool, count_all: bool) -> DataFrame:
    """(row, r): each row of ``docs`` as a struct, and (n_lines, n_removed, kept), null for an untouched row unless ``count_all``."""
    later = later_occurrences(_keyed(docs, id_col, text_col), fine)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(row, F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("own"), text.alias("text"))
    same = rows["doc"].eqNullSafe(later["doc"]) & (rows["own"] == later["own"])
    # Merged whatever the size, so that a small table is worked on, and takes the disk, like a large one.
    joined = rows.join(later.hint("merge"), same, "left").select("row", "text", "starts")
    units = pieces() if fine else F.flatten(F.transform(lines(), lambda of_line, i: F.transform(of_line, lambda u: F.struct(i.alias("line"), u.alias("unit")))))
    none = F.lit(None)
    if count_all:
        none = F.struct(F.size(units).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"))
    found = F.when(F.col("starts").isNotNull(), _cleaned(units, F.col("starts"), fine)).otherwise(none)
    # Made by a generator, as the optimizer copies any other column into every filter and projection above it.
    return joined.select("row", F.explode_outer(F.array(found)).alias("r"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fine: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, with ``_n_lines``, ``_n_removed`` (units) and ``_kept`` (the text that stays).

    A document of fewer than three units is kept whole. A null text counts as empty. Rows of one id and text are one
    document and get one result. Rows without an id come before all others. Lines that stay are joined as they were; a
    line that loses all its units goes with its line end. Columns of any other name stay as they are.

    ``fine``: units are pieces, and what repeats is removed if it has ``SURE_WORDS`` words, or three whole units of
    ``lines`` with ``MIN_WORDS`` words.
    """
    found = _with_results(docs, id_col, text_col, fine, count_all=True)
    return found.select(
        *(F.col("row")[c].alias(c) for c in docs.columns),
        F.col("r.n_lines").alias("_n_lines"), F.col("r.n_removed").alias("_n_removed"), F.col("r.kept").alias("_kept"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without repeated passages, found by pieces (``n_chars``, where there is one, counted anew).

    Untouched rows are as they were, a null text too. A document whose units all go has nothing of its own and goes. An
    empty table gives no row.
    """
    found = _with_results(docs, id_col, text_col, fine=True, count_all=False)
    cut = F.coalesce(F.col("r.n_removed") > 0, F.lit(False))
    left = found.where(~cut | (F.col("r.n_removed") < F.col("r.n_lines")))
    old = {c: F.col("row")[c] for c in docs.columns}
    new = {text_col: F.when(cut, F.col("r.kept")).otherwise(old[text_col])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("r.kept").cast(docs.schema["n_chars"].dataType)).otherwise(old["n_chars"])
    return left.select(*(new.get(c, old[c]).alias(c) for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of units, of those removed, and the text that stays."""
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept_text"))


# Windows by their text, not by a hash. Only for texts without the character U+0001.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, line_no, unnest(CASE WHEN len(string_split(line, ' ')) > 50
           THEN string_split(regexp_replace(line, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) ELSE [line] END) AS unit,
         generate_subscripts(CASE WHEN len(string_split(line, ' ')) > 50
           THEN string_split(regexp_replace(line, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) ELSE [line] END, 1) AS unit_no
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)
), u AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, unit_no) AS pos FROM l
), w AS (
  SELECT doc_id, pos, unit || chr(10) || lead(unit) OVER o || chr(10) || lead(unit, 2) OVER o AS g
  FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS n
  FROM w WHERE g IS NOT NULL AND len(regexp_extract_all(g, '[^ \t\r\n]+')) >= 8
), gone AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM later WHERE n > 1
), kept AS (
  SELECT u.*, lag(line_no) OVER (PARTITION BY u.doc_id ORDER BY u.pos) AS before
  FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.pos = gone.pos
), texts AS (
  SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN before = line_no THEN ' ' ELSE chr(10) END || unit, '' ORDER BY pos) AS t
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(t, '') AS kept_text
FROM (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id) d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN texts USING (doc_id)
"""
