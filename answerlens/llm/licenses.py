"""License scans by ordered signature rules. DataFrame and SQL functions only.

A rule is a label, a priority, keywords and a regex. Keywords are single words that every match holds, however its white
space is written, so looking for them first loses nothing; those a text has choose the rules, and only their regexes run. A detection inside the interval of another one is suppressed if
the other's priority is higher, or as high and its interval longer, or if rule order decides between equal intervals. All
of this happens within the row: nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents
from answerlens.llm.spans import places

# Keywords that are more than a word: an identifier, and how a text writes "cc by".
SPDX = "spdx-license-identifier"
CC_BY = "cc-by"
_CC_BY = r"\bcc(?:\s+|-)by"
# Base phrases and their labels: fixed.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Signature texts of licenses and notices: label, priority, keywords, regex (blanks stand for any white space). Every match
# of the regex holds all words of one of the alternatives, which ``|`` divides.
_SIGNATURES = (
    ("mit", 70, "hereby charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", 60, "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("mit", 45, "sublicense merge", r"to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"),
    ("mit-0", 40, "hereby charge", r"permission is hereby granted, free of charge, to any person"),
    ("isc", 70, "hereby fee", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 50, "author disclaims", r"the author disclaims all warranties with regard to this software"),
    ("0bsd", 60, "hereby provided", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided"),
    ("hpnd", 55, "modify documentation", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose"),
    ("bsd", 60, "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", 50, "redistributions retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 50, "redistributions reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 45, "provided contributors", r"this software is provided by the (?:copyright holders|regents|author) and contributors"),
    ("bsd-3-clause", 65, "neither contributors", r"neither the name of [^\n]{1,80} nor the names of its contributors may be used"),
    ("bsd-3-clause", 60, "endorse promote", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 65, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache", 60, "applicable writing", r"unless required by applicable law or agreed to in writing, software distributed under the license"),
    ("apache", 40, "obtain compliance", r"you may not use this file except in compliance with the license\. you may obtain a copy of the license at"),
    ("apache", 50, "foundation developed", r"this product includes software developed (?:by|at) the apache software foundation"),
    ("apache-2.0", 70, "apache licen", r"licensed under the apache license, version 2\.0"),
    ("apache-2.0", 60, "apache.org", r"www\.apache\.org/licenses/license-2\.0"),
    ("gpl", 60, "redistribute modify", r"(?:is|this program is) free software[:;] you can redistribute it and/or modify it under the terms"),
    ("gpl", 55, "merchantability", r"without any warranty; without even the implied warranty of merchantability or fitness"),
    ("gpl", 55, "received gnu", r"you should have received a copy of the gnu general public license"),
    ("gpl", 45, "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", 45, "freedom designed", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom"),
    ("gpl", 40, "modified prominent", r"you must cause (?:the|any) modified files to carry prominent notices"),
    ("gpl", 40, "absolutely warranty", r"comes with absolutely no warranty"),
    ("lgpl", 60, "received gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", 55, "library redistribute", r"this library is free software[:;] you can redistribute it"),
    ("agpl", 60, "received affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl", 50, "remotely network", r"all users interacting with it remotely through a computer network"),
    ("gfdl", 60, "invariant sections", r"with no invariant sections"),
    ("gfdl", 60, "granted document", r"permission is granted to copy, distribute and/or modify this document under the terms"),
    ("mpl", 60, "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", 60, "mozilla", r"the contents of this file are subject to the mozilla public license"),
    ("mpl", 50, "incompatible secondary", r"incompatible with secondary licenses"),
    ("mpl", 55, "mozilla.org", r"mozilla\.org/mpl/"),
    ("epl", 60, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", 55, "eclipse.org", r"eclipse\.org/legal/epl"),
    ("eupl", 60, "eupl", r"licensed under the eupl"),
    ("cddl", 60, "development distribution", r"subject to the terms of the common development and distribution license"),
    ("cecill", 60, "cecill", r"ce logiciel est régi par la licence cecill"),
    ("cecill", 60, "cecill", r"this software is governed by the cecill(?:-[bc])? license"),
    ("boost", 60, "hereby organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", 55, "boost.org", r"boost\.org/license_1_0\.txt"),
    ("zlib", 60, "provided implied", r"this software is provided ['‘]as[- ]is['’], without any express or implied warranty"),
    ("zlib", 60, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 55, "altered plainly", r"altered source versions must be plainly marked as such"),
    ("unlicense", 70, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 60, "anyone compile", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", 55, "unlicense.org", r"unlicense\.org"),
    ("wtfpl", 70, "want public", r"do what the f\S{0,4} you want to public license"),
    ("beerware", 70, "beer", r"\"?the beer-?ware license\"?"),
    ("beerware", 60, "beer", r"you can buy me a beer in return"),
    ("json", 60, "evil", r"the software shall be used for good, not evil"),
    ("openssl", 60, "openssl", r"this product includes software developed by the openssl project"),
    ("php", 60, "includes php", r"this product includes php software, freely available from"),
    ("python", 60, "psf python", r"psf is making python available to licensee"),
    ("vim", 60, "uganda", r"(?:help|benefit of) (?:poor )?children in uganda"),
    ("ncsa", 60, "deal restriction", r"to deal with the software without restriction"),
    ("freetype", 60, "freetype", r"portions of this software are copyright ©? ?(?:[0-9-]{4,9} )?the freetype project"),
    ("ms-pl", 55, "microsoft accept", r"this license governs use of the accompanying software\. if you use the software, you accept this license[^\n]{0,200}microsoft"),
    ("sspl", 60, "program service", r"offering the program as a service"),
    ("bsl", 60, "change date", r"(?:on|after) the change date"),
    ("elastic", 60, "hosted managed", r"as a hosted or managed service"),
    ("commons-clause", 60, "grant sell", r"the grant of rights under the license will not include[^\n]{0,80} the right to sell the software"),
    ("commons-clause", 50, "commons clause", r"commons clause"),
    ("odbl", 55, "individual database", r"any rights in individual contents of the database"),
    ("ogl", 60, "sector information", r"contains public sector information licensed under the open government licence"),
    ("ogl", 40, "government licen", r"open government licen[cs]e"),
    ("crown-copyright", 40, "crown copyright", r"crown copyright"),
    ("cc0", 70, "waived copyright|dedicated domain", r"(?:has waived all copyright|dedicated the work to the public domain)"),
    ("cc", 40, "licensed under", r"this work is licensed under a"),
    ("cc", 35, "view visit", r"to view a copy of this license, visit"),
    ("cc-by", 45, "appropriate credit", r"you must give appropriate credit, provide a link to the license"),
    ("cc-by-nc", 45, "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", 45, "remix modified", r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("cc-by-sa", 45, "remix contributions", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same license"),
    ("public-domain", 40, "domain", r"(?:released|placed|dedicated|given) (?:in|in?to) the public domain"),
    ("public-domain", 30, "domain", r"(?:is|are) in the public domain"),
    ("ofl", 60, "font sil", r"this font software is licensed under the sil open font license"),
    ("ofl", 50, "font reserved", r"with reserved font name"),
    ("artistic", 60, "artistic", r"the artistic license"),
    ("artistic", 45, "perl itself", r"(?:under the same terms|under the terms of either)[^\n]{0,80} as perl itself"),
    ("warranty-disclaimer", 20, "provided|distributed", r"(?:provided|distributed) (?:by [^\n]{1,60} )?[\"“'‘]?as is[\"”'’]?"),
    ("warranty-disclaimer", 15, "warranty", r"without warranty of any kind"),
    ("warranty-disclaimer", 15, "warranties disclaimed", r"(?:express or implied )?warranties[^\n]{0,160} are disclaimed"),
    ("warranty-disclaimer", 10, "entire risk", r"the entire risk as to the quality and performance"),
    ("liability-disclaimer", 15, "event shall", r"in no event shall (?:the )?(?:authors?|copyright (?:holders?|owners?))"),
    ("liability-disclaimer", 12, "liable damages", r"liable for any (?:direct|claim|damages|special)[^\n]{0,120} damages"),
    ("copyright", 10, "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)[0-9]{2}"),
    ("copyright", 9, "copyright", r"copyright \(c\)|copyright ©"),
    ("copyright", 8, "(c)", r"\(c\) (?:19|20)[0-9]{2}"),
    ("copyright", 8, "©", r"© ?(?:19|20)[0-9]{2}"),
    ("copyright", 5, "copyright", r"all copyrights? (?:is|are) held by"),
    ("copyright", 12, "copyright notice", r"the above copyright notice and this permission notice"),
    ("reserved", 30, "rights reserved", r"(?:all|some) rights reserved"),
    ("reserved", 10, "vorbehalten|servés|reservados", r"(?:alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)"),
    ("no-rights-reserved", 30, "rights reserved", r"no rights reserved"),
    ("proprietary", 40, "proprietary confidential", r"proprietary and confidential"),
    ("proprietary", 40, "proprietary confidential", r"confidential and proprietary"),
    ("proprietary", 30, "proprietary", r"proprietary (?:software|information|license|code)"),
    ("proprietary", 30, "unauthorized prohibited", r"unauthorized (?:copying|use|reproduction|distribution|duplication)[^\n]{0,40} (?:is )?(?:strictly )?prohibited"),
    ("proprietary", 25, "permission", r"(?:without|except with) (?:the )?(?:prior |express )*(?:written )?permission"),
    ("proprietary", 35, "trade secret", r"(?:contains|constitutes?) (?:valuable )?trade secrets?"),
    ("proprietary", 25, "internal only", r"for internal (?:company )?use only"),
    ("proprietary", 25, "reverse engineer", r"(?:may|shall|must) not (?:copy, modify, )?(?:decompile, )?reverse[- ]engineer"),
    ("evaluation", 25, "evaluation purposes", r"for evaluation purposes only"),
    ("non-commercial", 25, "commercial use only", r"for (?:personal and )?non-?commercial use only"),
    ("permissive", 10, "permission", r"(?:may be )?(?:used|copied|reproduced|distributed) with permission"),
    ("royalty-free", 10, "royalty", r"royalty[- ]free"),
    ("patent-grant", 15, "patent licen", r"(?:grants?|hereby grants?) [^\n]{0,60}patent licen[sc]e"),
    ("trademark", 5, "trademark", r"(?:registered )?trademarks? of"),
    ("copyleft", 5, "copyleft", r"copyleft"),
    ("dedication", 10, "dedicate copyright", r"dedicates? any and all copyright interest"),
    ("eula", 20, "user agreement", r"end[- ]user licen[sc]e agreement"),
    ("unknown-license", 1, "under licen", r"(?:licensed|released|distributed|published) under (?:the |a |an )?[^\n.]{1,60} licen[sc]e"),
)

# License families: label, a word of the name, name as a regex, versions, abbreviation as a regex.
_FAMILIES = (
    ("apache", "apache", r"apache(?: software)?", ("1.0", "1.1", "2.0"), r"apache"),
    ("gpl", "gnu", r"gnu general public", ("1", "2", "3"), r"gpl"),
    ("lgpl", "gnu", r"gnu (?:lesser|library) general public", ("2", "2.1", "3"), r"lgpl"),
    ("agpl", "affero", r"gnu affero general public", ("1", "3"), r"agpl"),
    ("gfdl", "documentation", r"gnu free documentation", ("1.1", "1.2", "1.3"), r"gfdl"),
    ("mpl", "mozilla", r"mozilla public", ("1.0", "1.1", "2.0"), r"mpl"),
    ("epl", "eclipse", r"eclipse public", ("1.0", "2.0"), r"epl"),
    ("eupl", "european", r"european union public", ("1.0", "1.1", "1.2"), r"eupl"),
    ("cddl", "development", r"common development and distribution", ("1.0", "1.1"), r"cddl"),
    ("cpl", "common", r"common public", ("1.0",), r"cpl"),
    ("cpal", "attribution", r"common public attribution", ("1.0",), r"cpal"),
    ("osl", "open", r"open software", ("1.0", "2.0", "2.1", "3.0"), r"osl"),
    ("afl", "academic", r"academic free", ("2.0", "2.1", "3.0"), r"afl"),
    ("artistic", "artistic", r"artistic", ("1.0", "2.0"), r"artistic"),
    ("ofl", "font", r"sil open font", ("1.0", "1.1"), r"ofl"),
    ("odbl", "database", r"open (?:data commons open )?database", ("1.0",), r"odbl"),
    ("php", "php", r"php", ("3.0", "3.01"), r"php"),
    ("python", "python", r"python software foundation", ("2",), r"psf"),
    ("python", "psf", r"psf", ("2",), r"psf"),
    ("ruby", "ruby", r"ruby", (), r"ruby"),
    ("boost", "boost", r"boost software", ("1.0",), r"bsl"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", (), r"zlib"),
    ("mit", "mit", r"mit", (), r"mit"),
    ("mit", "expat", r"expat", (), r"expat"),
    ("mit", "x11", r"x11", (), r"x11"),
    ("isc", "isc", r"isc", (), r"isc"),
    ("bsd", "bsd", r"(?:(?:modified|simplified|new|revised) )?bsd", (), r"bsd"),
    ("bsd-2-clause", "bsd", r"bsd[- ]2[- ]clause", (), r"bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"bsd[- ]3[- ]clause", (), r"bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"bsd[- ]4[- ]clause", (), r"bsd-4-clause"),
    ("ms-pl", "microsoft", r"microsoft public", (), r"ms-pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", (), r"ms-rl"),
    ("wtfpl", "wtfpl", r"wtfpl", (), r"wtfpl"),
    ("unlicense", "unlicense", r"unlicense", (), r"unlicense"),
    ("vim", "vim", r"vim", (), r"vim"),
    ("postgresql", "postgresql", r"postgresql", (), r"postgresql"),
    ("openssl", "openssl", r"openssl", (), r"openssl"),
    ("ncsa", "ncsa", r"(?:university of illinois/ncsa|ncsa) open source", (), r"ncsa"),
    ("cecill", "cecill", r"cecill", ("1.0", "2.0", "2.1"), r"cecill"),
    ("bsl", "business", r"business source", ("1.1",), r"busl"),
    ("sspl", "server", r"server side public", ("1",), r"sspl"),
    ("elastic", "elastic", r"elastic", ("2.0",), r"elastic"),
    ("upl", "universal", r"universal permissive", ("1.0",), r"upl"),
)
_CC = tuple("-".join(x) for x in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")))
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_CC_NAMES = {"by": "attribution", "sa": "share-?alike", "nd": "no-?deriv(?:ative)?s", "nc": "non-?commercial"}


def _spaced(regex: str) -> str:
    """A blank stands for white space of any kind and length, an optional one also for none, one in a set for one character."""
    out, inside, skip = [], False, False
    for i, c in enumerate(regex):
        if skip:
            skip = False
            continue
        inside = (inside or c == "[") and c != "]"
        skip = c == " " and not inside and regex[i + 1 : i + 2] == "?"
        out.append(c if c != " " else r"\s" if inside else r"\s*" if skip else r"\s+")
    return "".join(out)


def _rule(label: str, priority: int, words: str, regex: str) -> dict:
    """``words``: alternatives, divided by ``|``, of words that a match holds all of."""
    return dict(label=label, priority=priority, words=[alternative.split() for alternative in words.split("|")], regex=_spaced(regex))


def rules() -> list[dict]:
    """All rules in order: priority, then as they stand. Regexes match whatever the case of ASCII letters."""
    out = [_rule(*signature) for signature in _SIGNATURES]
    for label, key, name, versions, short in _FAMILIES:
        out += [
            _rule(label, 50, f"{key} licen", rf"\b{name} licen[sc]e"),
            _rule(label, 55, f"{key} licen", rf"(?:licensed|released|distributed|published|available) under (?:the |a |an )?(?:terms of (?:the )?)?{name} licen[sc]e"),
            _rule(label, 90, SPDX, rf"spdx-license-identifier: ?{short}\b"),
        ]
        for v in versions:
            number = re.escape(v) + ("" if "." in v else r"(?:\.0)?")
            out += [
                _rule(f"{label}-{v}", 75, f"{key} licen", rf"\b{name} licen[sc]e,? (?:\(\w{{1,8}}\) ?)?(?:version |v\.? ?)?{number}(?![0-9.]*[0-9])"),
                _rule(f"{label}-{v}", 95, SPDX, rf"spdx-license-identifier: ?{short}[- ]?v?{number}(?:-only|-or-later|\+)?(?![0-9.])"),
            ]
    out += [_rule(label, 30, "gpl", rf"\b{label}(?:[- ]?v?[0-9](?:\.[0-9])?)?\b") for label in ("gpl", "lgpl", "agpl")]
    for parts, version in product(_CC, (None, *_CC_VERSIONS)):
        tail = "" if version is None else rf"[ -]v?{re.escape(version)}"
        label = f"cc-{parts}" + ("" if version is None else f"-{version}")
        ends = r"(?![- ](?:sa|nc|nd)\b)(?![0-9])"
        for written in ("cc by", "cc-by"):
            out.append(_rule(label, 70 if version else 60, CC_BY, rf"\b{written}{parts[2:].replace('-', '[- ]')}{tail}{ends}"))
    for parts in _CC:
        words = "[- ]".join(_CC_NAMES[x] for x in parts.split("-"))
        out += [
            _rule(f"cc-{parts}", 60 + len(parts), "creative commons", rf"creative commons {words}"),
            _rule(f"cc-{parts}", 60 + len(parts), "creativecommons.org", rf"creativecommons\.org/licenses/{parts}/"),
        ]
    out += [_rule("cc", 20, "creative commons", "creative commons"), _rule("cc0", 70, "cc0", r"\bcc0(?:[- ]1\.0)?\b")]
    seen = set()
    out = [r | {"regex": f"(?i){r['regex']}"} for r in out if not ((key := (r["label"], r["regex"])) in seen or seen.add(key))]
    return [r | {"number": i} for i, r in enumerate(sorted(out, key=lambda r: -r["priority"]))]


_RULE = "struct<label:string,priority:int,words:array<array<string>>,regex:string,number:int>"
DETECTIONS = "array<struct<start:int,end:int,label:string,priority:int,number:int>>"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def keywords(signatures: list[dict], lowered: Column) -> Column:
    """The keywords of the rules that a lower-cased text holds."""
    every = sorted({w for r in signatures for alternative in r["words"] for w in alternative} - {CC_BY})
    plain = F.filter(F.lit(every), lambda k: F.contains(lowered, k))
    cc_by = F.contains(lowered, F.lit("cc")) & F.rlike(lowered, F.lit(_CC_BY))
    return F.when(cc_by, F.array_append(plain, F.lit(CC_BY))).otherwise(plain)


def detections(text: Column, present: Column, signatures: list[dict]) -> Column:
    """Detections of the rules that have an alternative with all its keywords present, before suppression."""
    table = F.from_json(F.lit(json.dumps(signatures)), f"array<{_RULE}>")

    def run(rule):
        found = places(text, rule["regex"])
        return F.transform(found, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["number"].alias("number")))

    def possible(rule):
        return F.exists(rule["words"], lambda alternative: F.forall(alternative, lambda w: F.array_contains(present, w)))

    chosen = F.filter(table, lambda r: possible(r) & F.rlike(text, r["regex"]))
    return F.flatten(F.transform(chosen, run))


def surviving(found: str) -> Column:
    """Detections that no other one suppresses."""

    def beats(other, own):
        inside = (other["start"] <= own["start"]) & (other["end"] >= own["end"])
        longer = (other["start"] < own["start"]) | (other["end"] > own["end"])
        return inside & ((other["priority"] > own["priority"]) | ((other["priority"] == own["priority"]) & (longer | (other["number"] < own["number"]))))

    return F.filter(found, lambda own: ~F.exists(found, lambda other: beats(other, own)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", signatures: list[dict] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, ``base`` (places of base phrases, as word numbers, with labels) and ``detections``.

    A null text counts as empty. Every row is scanned for itself, so ids may repeat or be null.
    """
    signatures = rules() if signatures is None else signatures
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    # The phrases' own words, apart from anything that is no word, must occur for the words to be looked at.
    phrase = "|".join(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+".join(p.split()) for p in BASE)
    maybe = (F.contains("low", F.lit("cc")) | F.contains("low", F.lit("general")) | F.contains("low", F.lit("reserved"))) & F.col("low").rlike(phrase)
    rows = rows.withColumns({
        "n_words": F.regexp_count("text", F.lit(_WORD)).cast("long"),
        "words": F.when(maybe, F.regexp_extract_all("low", F.lit(_WORD), F.lit(0))),
        "present": keywords(signatures, F.col("low")),
    })
    # A column of its own, so that it is not evaluated again for every rule.
    some = F.size("present") > 0
    rows = rows.withColumn("raw", F.when(some, detections(F.col("text"), F.col("present"), signatures)).otherwise(F.array().cast(DETECTIONS)))
    starts = F.sequence(F.lit(0), F.size("words") - 1)

    def occurrences(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def here(i):
            same = F.get("words", i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                same = same & F.coalesce(F.get("words", i + k) == part, F.lit(False))
            return same

        return F.transform(F.filter(starts, here), lambda i: F.struct(i.alias("word"), F.lit(label).alias("label")))

    found = F.flatten(F.array(*(occurrences(p, label) for p, label in BASE.items())))
    base = F.when(F.size("words") > 0, found).otherwise(F.array().cast("array<struct<word:int,label:string>>"))
    return rows.select("doc_id", "n_words", base.alias("base"), surviving("raw").alias("detections"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the places of base phrases, the labels of base and rules, and the strongest rule as a score."""
    found = scan_licenses(documents(spark, sf_dir))
    words = F.transform("base", lambda b: b["word"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("detections", lambda d: d["label"])))
    strongest = F.array_max(F.concat(F.transform("detections", lambda d: d["priority"]), F.transform("base", lambda b: F.lit(50)), F.array(F.lit(0))))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).cast("long").alias("first_word"),
        F.array_max(words).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (F.least(strongest, F.lit(100)) / F.lit(100.0)).alias("score"),
    )
