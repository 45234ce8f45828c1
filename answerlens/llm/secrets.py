"""Secret scans over a trigram index. DataFrame and SQL functions only.

Every rule's regex gives a Boolean query of trigrams that each match must contain: all of several clauses, of which each
holds if all trigrams of one of its alternatives occur. The index has, for the trigrams of all queries, the documents that
contain them, in blocks of about ``BLOCK_DOCS`` documents, so no posting list grows with the corpus. Postings are
intersected and united per block; the documents found are verified by the regex on their whole text. A rule without a
mandatory trigram is run on every text.

Documents are known to the index by a hash of id and text. Two that share it only cost a needless verification.
"""

from __future__ import annotations

import json
from re import _constants, _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents
from answerlens.llm.spans import places

BLOCK_DOCS = 4096
_MOST_STRINGS = 40


class Rule(NamedTuple):
    kind: str
    regex: str
    group: int = 0
    least: int = 0  # characters the group needs


# The first three are the base rules; their kinds and lengths are fixed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,10} ){0,3}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{1,100}@[A-Za-z0-9]"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}=*"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{50,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("shopify", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}"),
    Rule("azure_key", r"AccountKey=[A-Za-z0-9+/]{40,}=*"),
)
BASE = 3

Clause = list[frozenset[str]]


def trigram_query(regex: str) -> list[Clause]:
    """Clauses that the lower-cased text of every match satisfies. No clause: the rule has no mandatory trigram."""
    clauses: list[Clause] = []

    def flush(strings: set[str]) -> None:
        if min(map(len, strings)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            # An alternative that asks for more than another one adds nothing.
            clauses.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))

    def exact(nodes) -> set[str] | None:
        """All strings a sequence can match, lower-cased, if they are few; else None."""
        out = {""}
        for op, arg in nodes:
            own = one(op, arg)
            if own is None or len(out) * len(own) > _MOST_STRINGS:
                return None
            out = {a + b for a in out for b in own}
        return out

    def one(op, arg) -> set[str] | None:
        if op is _constants.LITERAL:
            return {chr(arg).lower()}
        if op is _constants.IN and all(o is _constants.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is _constants.SUBPATTERN:
            return exact(arg[3])
        if op is _constants.BRANCH:
            parts = [exact(x) for x in arg[1]]
            return None if None in parts or len(out := set().union(*parts)) > _MOST_STRINGS else out
        if op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and arg[1] is not _constants.MAXREPEAT and arg[1] <= 2:
            inner = exact(arg[2])
            if inner is None or arg[1] == 0:
                return inner and {""}
            out, grown = ({""} if arg[0] == 0 else set()), {""}
            for k in range(1, arg[1] + 1):
                grown = {a + b for a in grown for b in inner}
                out |= grown if k >= arg[0] else set()
            return out if len(out) <= _MOST_STRINGS else None
        return None

    def walk(nodes) -> None:
        run = {""}
        for op, arg in nodes:
            own = one(op, arg)
            if own is not None and len(run) * len(own) <= _MOST_STRINGS:
                run = {a + b for a in run for b in own}
                continue
            flush(run)
            run = own if own is not None else {""}
            if own is None and op is _constants.SUBPATTERN:
                walk(arg[3])
            elif own is None and op is _constants.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        flush(run)

    walk(_parser.parse(regex))
    return clauses


def doc_key() -> Column:
    return F.xxhash64("doc_id", "text")


def trigram_index(rows: DataFrame, trigrams: list[str], n_blocks: int) -> DataFrame:
    """(block, postings): a map from the number of a trigram to the keys of the block's documents that contain it."""
    low = rows.select(doc_key().alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    entries = low.select(F.pmod("key", F.lit(n_blocks)).cast("int").alias("block"), "key", F.explode(held).alias("trigram"))
    # Dealt by block once; both groupings below keep to it.
    lists = entries.repartition("block").groupBy("block", "trigram").agg(F.collect_set("key").alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))


def candidates(index: DataFrame, queries: dict[int, list[Clause]], trigrams: list[str]) -> DataFrame:
    """(key, rules): the rules whose query a document satisfies."""
    number = {t: i for i, t in enumerate(trigrams)}
    data = [{"rule": rule, "clauses": [[sorted(number[t] for t in alt) for alt in clause] for clause in q]} for rule, q in queries.items()]
    asked = F.from_json(F.lit(json.dumps(data)), "array<struct<rule:int,clauses:array<array<array<int>>>>>")

    def posting(t):
        return F.coalesce(F.try_element_at("postings", t), F.array().cast("array<long>"))

    def in_all(items, keys):
        rest = F.slice(items, F.lit(2), F.size(items))
        return F.aggregate(rest, keys(F.get(items, F.lit(0))), lambda done, x: F.array_intersect(done, keys(x)))

    def of_alternative(trigrams_):
        return in_all(trigrams_, posting)

    def of_clause(alternatives):
        return F.array_distinct(F.flatten(F.transform(alternatives, of_alternative)))

    found = F.transform(asked, lambda q: F.struct(q["rule"].alias("rule"), in_all(q["clauses"], of_clause).alias("keys")))
    pairs = index.select(F.inline(found)).select("rule", F.explode("keys").alias("key"))
    return pairs.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ``found``, an array of (start, rule number, end) in code points, sorted.

    A null text counts as empty. Rows that repeat an id, and rows without one, are scanned each for itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = {i: trigram_query(r.regex) for i, r in enumerate(rules)}
    mandatory = {i: q for i, q in queries.items() if q}
    trigrams = sorted({t for q in mandatory.values() for clause in q for alt in clause for t in alt})
    keyed = rows.withColumn("key", doc_key())
    if mandatory:
        n_blocks = -(-max(1, docs.count()) // BLOCK_DOCS)
        wanted = candidates(trigram_index(rows, trigrams, n_blocks), mandatory, trigrams)
        keyed = keyed.join(wanted, "key", "left")
    else:
        keyed = keyed.withColumn("rules", F.lit(None).cast("array<int>"))

    def spans(i: int, rule: Rule) -> Column:
        may = F.array_contains("rules", i) if i in mandatory else F.col("text").rlike(rule.regex)
        kept = F.filter(places(F.col("text"), F.lit(rule.regex), rule.group), lambda p: F.length(p["part"]) >= rule.least)
        made = F.transform(kept, lambda p: F.struct(p["start"].alias("start"), F.lit(i).alias("rule"), p["end"].alias("end")))
        return F.when(may, made).otherwise(F.array().cast("array<struct<start:int,rule:int,end:int>>"))

    out = [spans(i, rule) for i, rule in enumerate(rules)]
    return keyed.select("doc_id", F.array_sort(F.flatten(F.array(*out))).alias("found"))


def _written(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the numbers and places of its secrets."""
    found = find_secrets(documents(spark, sf_dir))
    of = lambda i: F.size(F.filter("found", lambda s: s["rule"] == i)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_written(F.filter("found", lambda s: s["rule"] < BASE), RULES), 256).alias("base_sha256"),
        _written(F.col("found"), RULES).alias("spans"),
    )
