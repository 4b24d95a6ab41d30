"""License scans: ordered signature rules over a text's words.

A text becomes its words, A-Z lower-cased, each wrapped in spaces of its own, so
that rules match whole words and two matches never share a boundary. Every rule has
a keyword that must occur before its regex is tried, and one regex over all
keywords sets most texts aside first. Detections are word intervals, taken from
left to right: one that lies inside the last that stays is suppressed, and of equal
ones the rule of higher priority stays; where it overlaps the last in part, the one
of higher priority stays, or else the first. All of it is one projection of
built-in functions, in which each regex that is tried runs once.

Names of licences are written by hand; their versions follow one pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Fixed values of the base: phrase and label.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Families: label, keyword, name (a regex over words), versions.
FAMILIES = (
    ("gpl", "general", "gnu general public licen[cs]e", "1.0 2.0 3.0"),
    ("lgpl", "lesser", "gnu lesser general public licen[cs]e", "2.1 3.0"),
    ("lgpl", "library", "gnu library general public licen[cs]e", "2.0"),
    ("agpl", "affero", "gnu affero general public licen[cs]e", "1.0 3.0"),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("gpl", "gpl", "gpl", "1.0 2.0 3.0"),
    ("lgpl", "lgpl", "lgpl", "2.0 2.1 3.0"),
    ("agpl", "agpl", "agpl", "1.0 3.0"),
    ("gfdl", "gfdl", "gfdl", "1.1 1.2 1.3"),
    ("apache", "apache", "apache (?:software )?licen[cs]e", "1.0 1.1 2.0"),
    ("apache", "asl", "asl", "1.1 2.0"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("mpl", "mpl", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "1.0 2.0"),
    ("epl", "epl", "epl", "1.0 2.0"),
    ("edl", "eclipse", "eclipse distribution licen[cs]e", "1.0"),
    ("cddl", "cddl", "cddl", "1.0 1.1"),
    ("cddl", "distribution", "common development and distribution licen[cs]e", "1.0 1.1"),
    ("cpl", "common", "common public licen[cs]e", "1.0"),
    ("ipl", "ibm", "ibm public licen[cs]e", "1.0"),
    ("eupl", "union", "european union public licen[cs]e", "1.0 1.1 1.2"),
    ("eupl", "eupl", "eupl", "1.0 1.1 1.2"),
    ("artistic", "artistic", "artistic licen[cs]e", "1.0 2.0"),
    ("python", "python", "python software foundation licen[cs]e", "2.0"),
    ("ruby", "ruby", "ruby licen[cs]e", ""),
    ("php", "php", "php licen[cs]e", "3.0 3.01"),
    ("zpl", "zope", "zope public licen[cs]e", "1.1 2.0 2.1"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[cs]e", ""),
    ("boost", "boost", "boost software licen[cs]e", "1.0"),
    ("zlib", "zlib", "zlib licen[cs]e", ""),
    ("libpng", "libpng", "libpng licen[cs]e", "2.0"),
    ("isc", "isc", "isc licen[cs]e", ""),
    ("mit", "mit", "mit licen[cs]e", ""),
    ("mit", "expat", "expat licen[cs]e", ""),
    ("mit-0", "attribution", "mit no attribution(?: licen[cs]e)?", ""),
    ("x11", "x11", "x11 licen[cs]e", ""),
    ("bsd", "bsd", "(?:new |modified |simplified |revised )?bsd licen[cs]e", ""),
    ("bsd-0-clause", "bsd", "(?:0|zero) clause bsd(?: licen[cs]e)?", ""),
    ("bsd-1-clause", "bsd", "(?:1|one) clause bsd(?: licen[cs]e)?", ""),
    ("bsd-2-clause", "bsd", "(?:2|two) clause bsd(?: licen[cs]e)?", ""),
    ("bsd-3-clause", "bsd", "(?:3|three) clause bsd(?: licen[cs]e)?", ""),
    ("bsd-4-clause", "bsd", "(?:4|four) clause bsd(?: licen[cs]e)?", ""),
    ("unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", "1.0 2.0"),
    ("beerware", "beerware", "beerware licen[cs]e", ""),
    ("public-domain", "domain", "(?:in|into|to) the public domain", ""),
    ("ofl", "ofl", "ofl", "1.0 1.1"),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", "1.0 1.1"),
    ("odbl", "database", "open (?:data commons open )?database licen[cs]e", "1.0"),
    ("odc-by", "commons", "open data commons attribution licen[cs]e", "1.0"),
    ("pddl", "pddl", "pddl", "1.0"),
    ("ogl", "government", "open government licen[cs]e", "1.0 2.0 3.0"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", ""),
    ("openssl", "openssl", "openssl licen[cs]e", ""),
    ("openldap", "openldap", "openldap public licen[cs]e", "2.7 2.8"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", ""),
    ("afl", "academic", "academic free licen[cs]e", "1.1 1.2 2.0 2.1 3.0"),
    ("ecl", "educational", "educational community licen[cs]e", "1.0 2.0"),
    ("osl", "open", "open software licen[cs]e", "1.0 1.1 2.0 2.1 3.0"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", ""),
    ("apsl", "apple", "apple public source licen[cs]e", "1.0 1.1 1.2 2.0"),
    ("qpl", "q", "q public licen[cs]e", "1.0"),
    ("cecill", "cecill", "cecill(?: free software licen[cs]e)?", "1.0 1.1 2.0 2.1"),
    ("sspl", "server", "server side public licen[cs]e", "1.0"),
    ("busl", "business", "business source licen[cs]e", "1.0 1.1"),
    ("elastic", "elastic", "elastic licen[cs]e", "2.0"),
    ("lppl", "latex", "latex project public licen[cs]e", "1.0 1.1 1.2 1.3"),
    ("upl", "universal", "universal permissive licen[cs]e", "1.0"),
    ("blueoak", "oak", "blue oak model licen[cs]e", "1.0.0"),
    ("vim", "vim", "vim licen[cs]e", ""),
    ("curl", "curl", "curl licen[cs]e", ""),
    ("icu", "icu", "icu licen[cs]e", ""),
    ("unicode", "unicode", "unicode licen[cs]e(?: agreement)?", ""),
    ("intel", "intel", "intel open source licen[cs]e", ""),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", ""),
    ("mulan", "mulan", "mulan permissive software licen[cs]e", "1.0 2.0"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m| d| s)?(?: licen[cs]e)?", "1.0"),
    ("cc0", "cc0", "cc0", "1.0"),
)
#: Creative Commons licences: terms, short and long form.
CC_TERMS = (
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nd", "by nd", "attribution no ?deriv(?:s|atives)"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:s|atives)"),
)
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
#: Notices that name no licence; the weakest rules.
NOTICES = (
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("copyright-notice", "copyright", "copyright (?:c )?[0-9][0-9][0-9][0-9]"),
    ("spdx", "spdx", "spdx licen[cs]e identifier [^ ]+"),
    ("permission-notice", "permission", "permission is hereby granted free of charge"),
    ("redistribution-notice", "redistribution", "redistribution and use in source and binary forms"),
    ("warranty-notice", "warranty", "without warranty of any kind"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str  # over words that are wrapped in one space each; without look-around
    priority: int  # 0 is the highest
    confidence: float
    base: bool = False


def _wrapped(words: str) -> str:
    """A regex with single spaces between words, as one over wrapped words."""
    out = words.replace(" ?", "\0").replace("(?: ", "\1").replace(" )?", "\2").replace(" ", "  ")
    return " " + out.replace("\0", "(?:  )?").replace("\1", "(?:  ").replace("\2", "  )?") + " "


def _version(v: str) -> str:
    """3.0 as in 'version 3', 'v3' or '3.0' (its dot ends a word); 2.1 only in full."""
    head, *rest = v.split(".")
    tail = "".join(f" {x}" for x in rest)
    return f"(?: version)?(?: or| v)? (?:v)?{head}" + ("(?: 0)?" if rest == ["0"] else tail)


def build_rules() -> tuple[Rule, ...]:
    rules = [Rule(label, phrase.split()[0], _wrapped(phrase), 3, 0.9, True) for phrase, label in BASE]
    for label, keyword, name, versions in FAMILIES:
        short = " " not in name
        if not short or not versions:
            rules.append(Rule(label, keyword, _wrapped(name), 4, 0.85))
        for v in versions.split():
            rules.append(Rule(f"{label}-{v}", keyword, _wrapped(name + _version(v)), 1 if short else 0, 0.8 if short else 1.0))
    for terms, brief, full in CC_TERMS:
        rules.append(Rule(f"cc-{terms}", "cc", _wrapped(f"cc {brief}"), 4, 0.85))
        rules.append(Rule(f"cc-{terms}", "commons", _wrapped(f"creative commons {full}"), 4, 0.9))
        for v in CC_VERSIONS.split():
            rules.append(Rule(f"cc-{terms}-{v}", "cc", _wrapped(f"cc {brief}{_version(v)}"), 1, 1.0))
            rules.append(Rule(f"cc-{terms}-{v}", "commons", _wrapped(f"creative commons {full}(?: international| unported)?(?: licen[cs]e)?{_version(v)}"), 0, 1.0))
    rules += [Rule(label, keyword, _wrapped(words), 9, 0.3) for label, keyword, words in NOTICES]
    return tuple(rules)


RULES = build_rules()
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IS_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def gate(rules: tuple[Rule, ...]) -> str:
    """One regex that holds wherever any rule's keyword is a word."""
    return " (?:" + "|".join(sorted({r.keyword for r in rules})) + ") "


def _words_in(s: Column) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("int")


def _detections(norm: Column, r: Column) -> Column:
    """Word intervals of one rule's matches: start, minus end, priority, rule."""
    # one pass sets a mark before and after each match; words have no such characters
    parts = F.split(F.regexp_replace(norm, r["regex"], F.lit("\x01$0\x02")), "\x01")
    steps = F.transform(
        F.slice(parts, F.lit(2), F.size(parts) - 1),
        lambda p: F.struct(_words_in(F.substring_index(p, "\x02", 1)).alias("n"), _words_in(F.substring_index(p, "\x02", -1)).alias("gap")),
    )
    empty = F.array().cast("array<struct<start:int,minus_end:int,priority:int,id:int>>")

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["n"]
        one = F.struct(acc["at"].alias("start"), (-end).alias("minus_end"), r["priority"].alias("priority"), r["id"].alias("id"))
        return F.struct((end + x["gap"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(steps, F.struct(_words_in(F.get(parts, 0)).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def license_scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, empty labels and score 0. A very long text
    is scanned whole. The score is the confidence of the strongest detection that
    stays; base detections count and label whether they stay or not. Ties of equal
    intervals go to the higher priority, then to the earlier rule. Repeated rows
    are scanned one by one; an empty table stays empty. Extra columns stay, but
    those named like an output are replaced.
    """
    trimmed, norm, hits, kept = (fresh(docs, f"__l_{x}") for x in ("trimmed", "norm", "hits", "kept"))
    fields = [
        F.struct(*(F.lit(v).alias(k) for k, v in {"id": i, "keyword": f" {r.keyword} ", "regex": r.regex, "priority": r.priority}.items()))
        for i, r in enumerate(rules)
    ]
    table = F.array(*fields)
    labels = F.array(*(F.lit(r.label) for r in rules))
    scores = F.array(*(F.lit(r.confidence) for r in rules))
    n_base = sum(r.base for r in rules)
    if not all(r.base for r in rules[:n_base]):
        raise ValueError("base rules come first")
    # one array of base detections, in the order of the table, and one of all
    out = docs.withColumn(trimmed, F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), NOT_WORD, "  ")))
    out = out.withColumn(norm, F.concat(F.lit(" "), F.col(trimmed), F.lit(" ")))
    tried = F.filter(table, lambda r: F.contains(F.col(norm), r["keyword"]))
    found = F.flatten(F.transform(tried, lambda r: _detections(F.col(norm), r)))
    out = out.withColumn("n_words", F.when(F.col(trimmed) == "", F.lit(0)).otherwise(_words_in(F.col(norm))).cast("long"))
    out = out.withColumn(hits, F.when(F.col(norm).rlike(gate(rules)), F.array_sort(found)))

    last = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("priority"), F.lit(-1).alias("id"))

    def sweep(acc: Column, x: Column) -> Column:
        now, end = acc["last"], -x["minus_end"]
        one = F.struct(end.alias("end"), x["priority"].alias("priority"), x["id"].alias("id"))
        apart = x["start"] >= now["end"]
        wins = (end > now["end"]) & (x["priority"] < now["priority"])
        return F.struct(
            F.when(apart | wins, one).otherwise(now).alias("last"),
            F.when(apart, F.array_union(acc["ids"], F.array(now["id"]))).otherwise(acc["ids"]).alias("ids"),
        )

    start = F.struct(last.alias("last"), F.array().cast("array<int>").alias("ids"))
    stays = F.aggregate(F.col(hits), start, sweep, lambda acc: F.filter(F.array_union(acc["ids"], F.array(acc["last"]["id"])), lambda i: i >= 0))
    base = F.filter(F.col(hits), lambda x: x["id"] < n_base)
    name = lambda ids: F.transform(ids, lambda i: F.get(labels, i))
    out = out.withColumn(kept, stays)
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_sort(F.array_distinct(name(F.transform(base, lambda x: x["id"])))), none)
    out = out.withColumns(
        {
            "n_base": F.coalesce(F.size(base), F.lit(0)).cast("long"),
            "first_word": F.array_min(F.transform(base, lambda x: x["start"])).cast("long"),
            "last_word": F.array_max(F.transform(base, lambda x: x["start"])).cast("long"),
            "base_labels": F.array_join(base_labels, ","),
            "labels": F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce(name(F.col(kept)), none))), ","),
            "score": F.coalesce(F.array_max(F.transform(F.col(kept), lambda i: F.get(scores, i))), F.lit(0.0)),
        }
    )
    return out.drop(trimmed, norm, hits, kept)
