"""License scans with ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm.common import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word and what stands between words, in texts whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases (words that stand consecutively) and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


class Rule(NamedTuple):
    """A regex over lower-cased text, tried only where both keywords occur; higher priorities win."""

    label: str
    keyword: str
    also: str
    pattern: str
    priority: int
    weight: float


#: label, distinctive keyword, and the name's regex (G stands for a gap between words).
_NAMES = (
    ("mit", "mit", r"mit"),
    ("mit-0", "mit", r"mitG(?:no attribution|0)"),
    ("x11", "x11", r"x11"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?:Glibpng)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("boost-1.0", "boost", r"boost(?:Gsoftware)?(?:G1G0)?"),
    ("apache-1.1", "apache", r"apache(?:Gsoftware)?Gv?(?:ersionG)?1G1"),
    ("apache-2.0", "apache", r"apache(?:Gsoftware)?(?:Glicense)?Gv?(?:ersionG)?2(?:G0)?"),
    ("apache", "apache", r"apache(?:Gsoftware)?"),
    ("bsd-2-clause", "bsd", r"(?:bsdG(?:2|two)Gclause|simplifiedGbsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsdG(?:3|three)Gclause|(?:new|modified|revised)Gbsd)"),
    ("bsd-4-clause", "bsd", r"bsdG(?:4|four)Gclause"),
    ("0bsd", "0bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd"),
    ("gpl-1.0", "gpl", r"(?:gnuG)?gpl(?:G?(?:v|version))?G?1(?:G0)?"),
    ("gpl-2.0", "gpl", r"(?:gnuG)?gpl(?:G?(?:v|version))?G?2(?:G0)?"),
    ("gpl-3.0", "gpl", r"(?:gnuG)?gpl(?:G?(?:v|version))?G?3(?:G0)?"),
    ("gpl", "gpl", r"(?:gnuG)?gpl"),
    ("gpl-1.0", "general", r"(?:gnuG)?general public license(?:G(?:v|version))?G?1(?:G0)?"),
    ("gpl-2.0", "general", r"(?:gnuG)?general public license(?:G(?:v|version))?G?2(?:G0)?"),
    ("gpl-3.0", "general", r"(?:gnuG)?general public license(?:G(?:v|version))?G?3(?:G0)?"),
    ("gpl", "general", r"(?:gnuG)?general public"),
    ("lgpl-2.0", "lgpl", r"(?:gnuG)?lgpl(?:G?(?:v|version))?G?2(?:G0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnuG)?lgpl(?:G?(?:v|version))?G?2G1"),
    ("lgpl-3.0", "lgpl", r"(?:gnuG)?lgpl(?:G?(?:v|version))?G?3(?:G0)?"),
    ("lgpl", "lgpl", r"(?:gnuG)?lgpl"),
    ("lgpl-2.1", "general", r"(?:gnuG)?(?:lesser|library) general public license(?:G(?:v|version))?G?2G1"),
    ("lgpl-3.0", "general", r"(?:gnuG)?lesser general public license(?:G(?:v|version))?G?3(?:G0)?"),
    ("lgpl", "general", r"(?:gnuG)?(?:lesser|library) general public"),
    ("agpl-3.0", "agpl", r"(?:gnuG)?agpl(?:G?(?:v|version))?G?3(?:G0)?"),
    ("agpl", "agpl", r"(?:gnuG)?agpl"),
    ("agpl-3.0", "affero", r"(?:gnuG)?affero general public license(?:G(?:v|version))?G?3(?:G0)?"),
    ("agpl", "affero", r"(?:gnuG)?affero general public"),
    ("gfdl", "documentation", r"(?:gnuG)?free documentation"),
    ("mpl-1.1", "mozilla", r"mozilla public(?:Glicense)?(?:G(?:v|version))?G1G1"),
    ("mpl-2.0", "mozilla", r"mozilla public(?:Glicense)?(?:G(?:v|version))?G2(?:G0)?"),
    ("mpl", "mozilla", r"mozilla public"),
    ("epl-1.0", "eclipse", r"eclipse public(?:Glicense)?(?:G(?:v|version))?G1(?:G0)?"),
    ("epl-2.0", "eclipse", r"eclipse public(?:Glicense)?(?:G(?:v|version))?G2(?:G0)?"),
    ("epl", "eclipse", r"eclipse public"),
    ("eupl", "european", r"european union public"),
    ("cddl", "development", r"common development and distribution"),
    ("cpl", "common", r"common public"),
    ("artistic-1.0", "artistic", r"artistic(?:Glicense)?G1(?:G0)?"),
    ("artistic-2.0", "artistic", r"artistic(?:Glicense)?G2(?:G0)?"),
    ("python", "python", r"python software foundation"),
    ("openssl", "openssl", r"openssl"),
    ("ofl", "font", r"(?:silG)?open font"),
    ("cc0", "cc0", r"cc0"),
    ("cc0", "creative", r"creative commonsG(?:cc0|zero)"),
    ("cc-by-sa", "cc", r"ccGbyGsa(?:G[0-9]G[0-9])?"),
    ("cc-by-nc-sa", "cc", r"ccGbyGncGsa(?:G[0-9]G[0-9])?"),
    ("cc-by-nc-nd", "cc", r"ccGbyGncGnd(?:G[0-9]G[0-9])?"),
    ("cc-by-nc", "cc", r"ccGbyGnc(?:G[0-9]G[0-9])?"),
    ("cc-by-nd", "cc", r"ccGbyGnd(?:G[0-9]G[0-9])?"),
    ("cc-by", "cc", r"ccGby(?:G[0-9]G[0-9])?"),
    ("cc-by-sa", "creative", r"creative commonsGattributionGshareG?alike"),
    ("cc-by-nc-sa", "creative", r"creative commonsGattributionGnonG?commercialGshareG?alike"),
    ("cc-by-nc-nd", "creative", r"creative commonsGattributionGnonG?commercialGnoG?deriv(?:ative)?s?"),
    ("cc-by-nc", "creative", r"creative commonsGattributionGnonG?commercial"),
    ("cc-by-nd", "creative", r"creative commonsGattributionGnoG?deriv(?:ative)?s?"),
    ("cc-by", "creative", r"creative commonsGattribution"),
    ("odbl", "database", r"open database"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("upl", "universal", r"universal permissive"),
    ("ncsa", "illinois", r"university of illinoisG(?:ncsaG)?open source"),
    ("postgresql", "postgresql", r"postgresql"),
    ("busl", "business", r"business source"),
    ("sspl", "server", r"server side public"),
    ("elastic", "elastic", r"elastic"),
    ("public-domain", "domain", r"public domain"),
)
#: form -> (what the text must contain, and what it must match where that is not enough; regex around N, priority, weight)
_FORMS = (
    ("spdx", "spdx", None, r"spdxGlicenseGidentifierGN(?:Gonly|GorGlater)?", 90, 1.0),
    ("under", "under", r"(?:licensed|released|distributed|available|provided|published|redistributed)Gunder", r"(?:licensed|released|distributed|available|provided|published|redistributed)Gunder(?:G(?:the|a|an))?(?:Gterms of the)?GN(?:Gpublic)?(?:Glicen[sc]e)?(?:Gv(?:ersion)?G[0-9]+(?:G[0-9]+)?)?", 80, 0.95),
    ("notice", "licen", None, r"(?:the|this)GNGlicen[sc]e(?:Gv(?:ersion)?G[0-9]+(?:G[0-9]+)?)?", 60, 0.8),
    ("field", "licen", None, r"licen[sc]e(?:d|s)?(?:Gtype)?G(?:isG)?N", 50, 0.7),
    ("name", "licen", None, r"NGlicen[sc]e", 40, 0.6),
)
#: Names so short that they stand inside many words: these count only where they stand alone.
_ALONE = ("cc", "mit", "isc", "x11")
#: label, keyword, regex, priority and weight of rules that are no name in a form.
_TEXTS = (
    ("mit", "granted", r"permission is hereby grantedGfree of chargeGto any person obtaining a copy", 100, 1.0),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 100, 1.0),
    ("mit", "sublicense", r"rights to useGcopyGmodifyGmergeGpublishGdistributeGsublicense", 95, 0.9),
    ("isc", "permission", r"permission to useGcopyGmodifyGand(?:Gor)?Gdistribute this software for any purpose", 100, 1.0),
    ("isc", "loss of use", r"special direct indirect or consequential damages or any damages whatsoever resulting from loss of use", 80, 0.7),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms", 100, 1.0),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 95, 0.9),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 95, 0.9),
    ("bsd-3-clause", "endorse", r"neither the name of[^.]{1,120}may be used to endorse or promote products", 98, 1.0),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 98, 1.0),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license", 95, 0.9),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing", 90, 0.8),
    ("apache-2.0", "contributor", r"each contributor hereby grants to you a perpetual", 95, 0.9),
    ("gpl", "redistribute", r"(?:this program|it) is free softwareGyou can redistribute it", 100, 1.0),
    ("gpl", "published", r"gnuGgeneral public licenseG?as published by the free software foundation", 95, 1.0),
    ("gpl-2.0", "later version", r"either version 2 of the licenseGor(?:Gat your option)?Gany later version", 96, 1.0),
    ("gpl-3.0", "later version", r"either version 3 of the licenseGor(?:Gat your option)?Gany later version", 96, 1.0),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose", 70, 0.7),
    ("lgpl", "lesser", r"gnuGlesser general public licenseG?as published by the free software foundation", 97, 1.0),
    ("agpl", "affero", r"gnuGaffero general public licenseG?as published by the free software foundation", 97, 1.0),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license", 100, 1.0),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file", 100, 1.0),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 100, 1.0),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 95, 0.9),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 95, 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 100, 1.0),
    ("unlicense", "anyone is free", r"anyone is free to copyGmodifyGpublishGuseGcompileGsellGor distribute", 95, 0.9),
    ("boost-1.0", "boost", r"boost software license", 70, 0.9),
    ("ofl", "font software", r"this font software is licensed under the sil open font license", 100, 1.0),
    ("ofl", "font software", r"the font software may be modified or redistributed", 90, 0.8),
    ("cc0", "waived", r"waived all copyright and related or neighbou?ring rights", 95, 0.9),
    ("cc0", "extent", r"to the extent possible under lawG[^.]{1,80}waived", 95, 0.9),
    ("cc", "creative", r"this work is licensed under a creative commons", 60, 0.8),
    ("public-domain", "domain", r"(?:dedicated to|placed in(?:to)?|released into|committed to) the public domain", 85, 0.9),
    ("public-domain", "domain", r"no copyright is claimed", 60, 0.6),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 70, 0.8),
    ("proprietary", "copying", r"unauthori[sz]ed copying", 70, 0.8),
    ("proprietary", "reproduction", r"unauthori[sz]ed (?:reproduction|distribution|duplication)", 70, 0.8),
    ("proprietary", "reproduced", r"may not be reproduced", 65, 0.7),
    ("proprietary", "no part of", r"no part of this (?:publication|book|document|work|file) may be", 70, 0.8),
    ("proprietary", "internal use", r"for internal use only", 60, 0.6),
    ("proprietary", "trade secret", r"trade secrets? (?:of|and confidential)", 60, 0.6),
    ("proprietary", "permission", r"without (?:the )?(?:prior|express) written permission", 60, 0.6),
    ("copyright", "copyright", r"copyright(?:Gc)?G(?:19|20)[0-9]{2}", 30, 0.5),
    ("copyright", "©", "© ?(?:19|20)[0-9]{2}", 30, 0.5),
    ("reserved", "reserved", r"all rights reserved", 30, 0.5),
    ("reserved", "reserved", r"some rights reserved", 30, 0.5),
    ("cc-by", "cc", r"ccGby", 45, 0.7),
)


_START, _END = f"(?<!{WORD[:-1]})", f"(?!{WORD[:-1]})"


def spelled(pattern: str) -> str:
    """A regex with G, or a blank, standing for any run between words."""
    return pattern.replace(" ", "G").replace("GG?", "G?").replace("G?G", "G").replace("G?", f"(?:{_GAP})?").replace("G", _GAP)


def signature_rules() -> list[Rule]:
    """All rules: every name in every form, and the texts."""
    whole = lambda p: f"{_START}(?:{spelled(p)}){_END}"
    out = [Rule(label, keyword, also, whole(form.replace("N", f"(?:{name})")), priority, weight) for label, keyword, name in _NAMES for _, also, _, form, priority, weight in _FORMS]
    return out + [Rule(label, keyword, keyword, whole(pattern), priority, weight) for label, keyword, pattern, priority, weight in _TEXTS]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _holds(low: Column, word: str) -> Column:
    """Whether a lower-cased text holds a keyword; short names only where they stand alone."""
    return low.rlike(_from(word) + _END) if word in _ALONE else F.contains(low, F.lit(word))


def _from(word: str) -> str:
    """A word at a word's start; the letters come first, so that a search fails at most places on the first of them."""
    return f"{word}(?<!{WORD[:-1]}{word})"


def _phrase(low: Column, phrase: str) -> Column:
    """Whether a lower-cased text holds the phrase's words one behind the other."""
    first, *rest = phrase.split(" ")
    return F.contains(low, F.lit(first)) & F.contains(low, F.lit(rest[-1])) & low.rlike(_from(first) + "".join(_GAP + w for w in rest) + _END)


def _any(words: Sequence[str], low: Column) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | _holds(low, word)
    return out


def _rule_array(rules: Sequence[Rule]) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("order"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.also).alias("also"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight")) for i, r in enumerate(rules)))


def _spans(text: Column, rule: Column) -> Column:
    """Intervals of a rule's matches: what precedes a match is what splitting leaves before it."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    between = F.split(text, rule["pattern"])
    return F.transform(
        found,
        lambda m, i: F.struct(
            (F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, x: a + F.length(x))).alias("start"),
            F.length(m).alias("length"),
            rule["priority"].alias("priority"),
            rule["order"].alias("order"),
            rule["label"].alias("label"),
            rule["weight"].alias("weight"),
        ),
    )


def _places(words: Column, phrase: list[str], label: str) -> Column:
    """Where the phrase's words stand consecutively."""
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())
    fits = F.filter(starts, lambda i: F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))
    return F.transform(fits, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def scan_licenses(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Scans every row's whole text for license wording.

    docs: doc_id and text (others are ignored). A-Z are lower-cased first. Base labels come
    from phrases whose words stand consecutively. Of the rules whose keyword a text holds,
    all matches are taken; a match that lies inside another's interval is suppressed unless
    its priority is higher, and of equal intervals the higher priority (then the earlier
    rule) stays; an interval covered by a match of lower priority stays too, and that match
    is suppressed only if it lies inside one of higher or equal priority. Returns doc_id,
    n_words, n_base, first_word, last_word, base_labels, labels, score (largest weight of
    the matches left; at least 0.5 with a base label; 0 without either) and detections
    (label, start and length in characters, priority). Null and empty texts have no words,
    places or labels; repeated rows are scanned alike; an empty table gives no rows.
    """
    rules = signature_rules() if rules is None else list(rules)
    text = F.coalesce("text", F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    rows = docs.select("doc_id", text.alias("raw"), F.lower(text).alias("hint"), ascii_only.alias("plain"))
    rows = rows.withColumn("n_words", F.regexp_count("raw", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++")).cast("long"))
    # the lower-cased text serves as a hint only: letters beyond ASCII may change in it, ASCII ones stand where they stood
    hint = F.col("hint")
    needs = {also: regex for _, also, regex, *_ in _FORMS if regex}
    seconds = sorted({r.also for r in rules if r.also != r.keyword})
    gates = {also: _holds(hint, also) & (hint.rlike(spelled(needs[also])) if also in needs else F.lit(True)) for also in seconds}
    single = sorted({r.keyword for r in rules if r.also == r.keyword})
    based = F.lit(False)
    for phrase, _ in BASE:
        based = based | _phrase(hint, phrase)
    rows = rows.withColumn("based", based)
    gated = F.col("based") | _any(single, hint)
    for gate in gates.values():
        gated = gated | gate
    rows = rows.withColumn("gated", gated)
    rows = rows.withColumn("low", F.when(~F.col("gated"), F.lit("")).when(F.col("plain"), F.col("hint")).otherwise(lower_ascii(F.col("raw"))))
    none = F.array().cast("array<string>")
    present = lambda words, holds: F.filter(F.array(*(F.when(holds(w), F.lit(w)) for w in words)), lambda w: w.isNotNull()) if words else none
    rows = rows.withColumn("second", F.when(F.col("gated"), present(seconds, lambda w: gates[w])).otherwise(none))
    # keywords of names count only where some form may stand
    names = sorted({r.keyword for r in rules if r.also != r.keyword} - set(single))
    rows = rows.withColumn("held", F.when(F.col("gated"), F.concat(present(single, lambda w: _holds(hint, w)), F.when(F.size("second") > 0, present(names, lambda w: _holds(hint, w))).otherwise(none))).otherwise(none)).drop("raw", "hint")
    words = F.when(F.col("based"), F.regexp_extract_all("low", F.lit(WORD), F.lit(0))).otherwise(none)
    rows = rows.withColumn("words", words)
    places = [_places(F.col("words"), phrase.split(" "), label) for phrase, label in BASE]
    rows = rows.withColumn("base", F.when(F.size("words") > 0, F.concat(*places)).otherwise(F.array().cast("array<struct<at:int,label:string>>")))
    usable = F.filter(_rule_array(rules), lambda r: F.array_contains(F.col("held"), r["keyword"]) & ((r["also"] == r["keyword"]) | F.array_contains(F.col("second"), r["also"])))
    spans = F.flatten(F.transform(usable, lambda r: _spans(F.col("low"), r)))
    empty = F.array().cast("array<struct<start:int,length:int,priority:int,order:int,label:string,weight:double>>")
    rows = rows.withColumn("spans", F.when(F.size("held") > 0, spans).otherwise(empty))
    inside = lambda a, b: (a["start"] >= b["start"]) & (a["start"] + a["length"] <= b["start"] + b["length"])
    same = lambda a, b: (a["start"] == b["start"]) & (a["length"] == b["length"])
    beats = lambda b, a: inside(a, b) & F.when(same(a, b), (b["priority"] > a["priority"]) | ((b["priority"] == a["priority"]) & (b["order"] < a["order"]))).otherwise(b["priority"] >= a["priority"])
    rows = rows.withColumn("left", F.filter("spans", lambda a: ~F.exists("spans", lambda b: beats(b, a))))
    named = lambda array: F.array_join(F.array_sort(F.array_distinct(array)), ",")
    base_names = F.transform("base", lambda b: b["label"])
    at = F.transform("base", lambda b: b["at"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("left", lambda a: a["weight"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        named(base_names).alias("base_labels"),
        named(F.concat(base_names, F.transform("left", lambda a: a["label"]))).alias("labels"),
        best.alias("score"),
        F.transform("left", lambda a: F.struct(a["label"].alias("label"), a["start"].alias("start"), a["length"].alias("length"), a["priority"].alias("priority"))).alias("detections"),
    )


def op9_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wording of every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
