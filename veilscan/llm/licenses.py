"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a label, a kind and a pattern over lower-cased text.  Its keywords, parts of words that every
match holds, gate it: RE2 first tells which texts hold any rule's keyword at all, an Aho-Corasick automaton
then tells which keywords, and only rules that have all theirs are run.  Rules are ordered by the
priority of their kind: a detection that lies within another of the same or a higher priority is
suppressed ("general public license" within "gnu lesser general public license, version 3").  Rules
marked ``base`` are reported wherever they match.

The whole text is read.  Patterns hold no nested repetition, so that they take linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilscan.llm.common import slices

#: Priority and confidence of what a rule looks for.
KINDS = {
    "grant": (60, 1.0),    # a sentence of the license itself
    "tag": (50, 1.0),      # a machine-readable identifier
    "name": (40, 0.95),    # the name with its version
    "url": (40, 0.9),      # the license's address
    "short": (30, 0.8),    # an abbreviation with its version
    "plain": (20, 0.6),    # the name alone
    "base": (10, 0.5),     # a phrase looked for word by word
}


@dataclass(frozen=True)
class Signature:
    """In ``pattern`` a space stands for what lies between words, ``~`` for the same or nothing.

    ``keywords`` are parts of words, separated by spaces, all of which every match holds.
    """

    label: str
    kind: str
    pattern: str
    keywords: str

    @property
    def name(self) -> str:
        return f"{self.label}:{self.kind}"


# License families as (label, keyword, pattern of the name, pattern of the abbreviation,
# pattern of the address, versions).  ``{v}`` is the version.
VERSIONED = [
    ("gpl", "gnu", "gnu general public licen[cs]e", "", "gnu[.]org/licenses/(?:old-licenses/)?gpl-{v}", "1.0 2.0 3.0"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public licen[cs]e", "",
     "gnu[.]org/licenses/(?:old-licenses/)?lgpl-{v}", "2.0 2.1 3.0"),
    ("agpl", "gnu", "gnu affero general public licen[cs]e", "", "gnu[.]org/licenses/agpl-{v}", "1.0 3.0"),
    ("gfdl", "gnu", "gnu free documentation licen[cs]e", "", "gnu[.]org/licenses/(?:old-licenses/)?fdl-{v}",
     "1.1 1.2 1.3"),
    ("gpl", "gpl", "", "gpl", "opensource[.]org/licen[cs]es?/gpl-{v}", "1.0 2.0 3.0"),
    ("lgpl", "lgpl", "", "lgpl", "opensource[.]org/licen[cs]es?/lgpl-{v}", "2.0 2.1 3.0"),
    ("agpl", "agpl", "", "agpl", "opensource[.]org/licen[cs]es?/agpl-{v}", "1.0 3.0"),
    ("gfdl", "fdl", "", "g?fdl", "", "1.1 1.2 1.3"),
    ("apache", "apache", "apache (?:software )?licen[cs]e", "(?:apache|asl)", "apache[.]org/licenses/license-{v}",
     "1.0 1.1 2.0"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "", "mozilla[.]org/(?:en-us/)?mpl/{v}", "1.0 1.1 2.0"),
    ("mpl", "mpl", "", "mpl", "opensource[.]org/licen[cs]es?/mpl-{v}", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "", "eclipse[.]org/legal/epl-v?{v}", "1.0 2.0"),
    ("epl", "epl", "", "epl", "opensource[.]org/licen[cs]es?/epl-{v}", "1.0 2.0"),
    ("cddl", "distribution license", "common development and distribution license", "", "", "1.0 1.1"),
    ("cddl", "cddl", "", "cddl", "opensource[.]org/licen[cs]es?/cddl-{v}", "1.0 1.1"),
    ("cpl", "common public", "common public licen[cs]e", "", "opensource[.]org/licen[cs]es?/cpl{v}", "1.0"),
    ("eupl", "european union public", "european union public licen[cs]e", "", "", "1.0 1.1 1.2"),
    ("eupl", "eupl", "", "eupl", "", "1.0 1.1 1.2"),
    ("artistic", "artistic", "artistic licen[cs]e", "artistic", "perlfoundation[.]org/artistic_license_{v}", "1.0 2.0"),
    ("bsl", "boost", "boost software licen[cs]e", "", "boost[.]org/license_{v}", "1.0"),
    ("bsl", "bsl", "", "bsl", "", "1.0"),
    ("busl", "business source", "business source licen[cs]e", "", "mariadb[.]com/bsl{v}", "1.0 1.1"),
    ("osl", "open software", "open software licen[cs]e", "", "opensource[.]org/licen[cs]es?/osl-{v}", "1.0 2.0 2.1 3.0"),
    ("osl", "osl", "", "osl", "", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free", "academic free licen[cs]e", "", "opensource[.]org/licen[cs]es?/afl-{v}",
     "1.1 1.2 2.0 2.1 3.0"),
    ("afl", "afl", "", "afl", "", "1.1 1.2 2.0 2.1 3.0"),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", "", "", "1.0 1.1"),
    ("ofl", "ofl", "", "(?:sil )?ofl", "scripts[.]sil[.]org/ofl", "1.0 1.1"),
    ("lppl", "latex project", "latex project public licen[cs]e", "", "latex-project[.]org/lppl/lppl-{v}",
     "1.0 1.1 1.2 1.3"),
    ("lppl", "lppl", "", "lppl", "", "1.0 1.1 1.2 1.3"),
    ("cecill", "cecill", "cecill (?:free software )?licen[cs]e", "cecill", "cecill[.]info/licences/licence_cecill_v{v}",
     "1.0 1.1 2.0 2.1"),
    ("zpl", "zope", "zope public licen[cs]e", "", "", "1.1 2.0 2.1"),
    ("zpl", "zpl", "", "zpl", "", "1.1 2.0 2.1"),
    ("php", "php licen", "php licen[cs]e", "", "php[.]net/license/{v}", "3.0 3.01"),
    ("psf", "python software foundation", "python software foundation licen[cs]e", "", "", "1.6 2.0"),
    ("apsl", "apple public", "apple public source licen[cs]e", "", "opensource[.]apple[.]com/license/apsl", "1.0 1.1 1.2 2.0"),
    ("ecl", "educational community", "educational community licen[cs]e", "", "", "1.0 2.0"),
    ("efl", "eiffel forum", "eiffel forum licen[cs]e", "", "", "1.0 2.0"),
    ("sspl", "server side public", "server side public licen[cs]e", "", "mongodb[.]com/licensing/server-side-public-license",
     "1.0"),
    ("elastic", "elastic", "elastic licen[cs]e", "elastic", "elastic[.]co/licensing/elastic-license", "1.0 2.0"),
    ("polyform", "polyform", "polyform (?:noncommercial|shield|strict|small business) licen[cs]e", "",
     "polyformproject[.]org/licenses/[a-z-]+/{v}", "1.0"),
    ("upl", "universal permissive", "universal permissive licen[cs]e", "", "", "1.0"),
    ("ncsa", "illinois", "university of illinois/?~ncsa open source licen[cs]e", "", "opensource[.]org/licen[cs]es?/ncsa", "1.0"),
    ("odbl", "open database", "(?:odc )?open database licen[cs]e", "", "opendatacommons[.]org/licenses/odbl/{v}", "1.0"),
    ("pddl", "public domain dedication", "(?:odc )?public domain dedication and licen[cs]e", "",
     "opendatacommons[.]org/licenses/pddl/{v}", "1.0"),
    ("odc-by", "data commons attribution", "open data commons attribution licen[cs]e", "",
     "opendatacommons[.]org/licenses/by/{v}", "1.0"),
    ("ogl", "open government", "open government licen[cs]e", "", "nationalarchives[.]gov[.]uk/doc/open-government-licence/version/",
     "1.0 2.0 3.0"),
    ("etalab", "licence ouverte", "licence ouverte(?:/?~open licen[cs]e)?", "", "", "1.0 2.0"),
    ("dl-de-by", "datenlizenz", "datenlizenz deutschland(?: namensnennung)?", "", "govdata[.]de/dl-de/by-2-0", "1.0 2.0"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?:\\+\\+)?(?: m)?(?: licen[cs]e)?", "", "", "1.0"),
]

#: Creative Commons licenses: label, words of the name, and the versions of all.
CREATIVE = [
    ("cc-by", "attribution", "by"),
    ("cc-by-sa", "attribution share~alike", "by sa"),
    ("cc-by-nd", "attribution no~deriv(?:ative)?s?", "by nd"),
    ("cc-by-nc", "attribution non~commercial", "by nc"),
    ("cc-by-nc-sa", "attribution non~commercial share~alike", "by nc sa"),
    ("cc-by-nc-nd", "attribution non~commercial no~deriv(?:ative)?s?", "by nc nd"),
]
CREATIVE_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

#: Licenses without versions: label, keyword, pattern of the name, SPDX identifier.
PLAIN = [
    ("mit", "mit licen", "(?:the )?(?:mit|expat)(?: x11)? licen[cs]e", "mit"),
    ("mit", "mit licen under", "licen[cs]ed under(?: the)?(?: terms of)?(?: the)? mit", ""),
    ("mit-0", "no attribution", "mit no attribution", "mit-0"),
    ("x11", "x11", "x11 licen[cs]e", "x11"),
    ("isc", "isc licen", "isc licen[cs]e", "isc"),
    ("zlib", "zlib", "zlib(?:/?~libpng)? licen[cs]e", "zlib"),
    ("libpng", "libpng", "libpng licen[cs]e", "libpng"),
    ("unlicense", "unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "the fuck you want", "do what the fuck you want to public licen[cs]e", ""),
    ("0bsd", "zero clause", "zero clause bsd(?: licen[cs]e)?", "0bsd"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd) (?:bsd )?licen[cs]e", "bsd-2-clause"),
    ("bsd-2-clause", "bsd", "(?:2|two) clause bsd(?: licen[cs]e)?", ""),
    ("bsd-2-clause", "bsd", "bsd (?:2|two) clause(?: licen[cs]e)?", ""),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised) bsd(?: licen[cs]e)?", "bsd-3-clause"),
    ("bsd-3-clause", "bsd", "(?:3|three) clause bsd(?: licen[cs]e)?", ""),
    ("bsd-3-clause", "bsd", "bsd (?:3|three) clause(?: licen[cs]e)?", ""),
    ("bsd-4-clause", "bsd", "(?:4|four) clause bsd(?: licen[cs]e)?", "bsd-4-clause"),
    ("bsd-4-clause", "bsd", "bsd (?:4|four) clause(?: licen[cs]e)?", ""),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", ""),
    ("bsd", "bsd", "licen[cs]ed under(?: the)?(?: terms of)?(?: the)? bsd", ""),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl"),
    ("curl", "curl licen", "curl licen[cs]e", "curl"),
    ("ruby", "ruby licen", "ruby licen[cs]e", "ruby"),
    ("vim", "vim licen", "vim licen[cs]e", "vim"),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", "sleepycat"),
    ("beerware", "beerware", "beerware licen[cs]e", "beerware"),
    ("json", "json licen", "json licen[cs]e", "json"),
    ("ijg", "independent jpeg", "independent jpeg group", "ijg"),
    ("unicode", "unicode", "unicode(?:,? inc[.]?)? licen[cs]e agreement", "unicode-3.0"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[cs]e", "w3c"),
    ("naist", "naist", "naist 2003 licen[cs]e", "naist-2003"),
    ("bigscience-rail", "responsible licen", "responsible ai licen[cs]e", ""),
    ("llama", "llama", "llama [0-9.]+ community licen[cs]e", ""),
    ("gemma", "gemma", "gemma terms of use", ""),
    ("cc0", "cc0", "cc0(?: 1[.]0)?(?: universal)?", "cc0-1.0"),
    ("cc0", "creative commons", "creative commons zero", ""),
    ("public-domain", "public domain", "(?:released|placed|dedicated)(?: in)?(?: into| to)? the public domain", ""),
    ("public-domain", "public domain", "(?:is|are) in the public domain", ""),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", ""),
    ("proprietary", "proprietary", "proprietary and confidential", ""),
    ("proprietary", "written permission", "(?:may|must) not be (?:copied|reproduced|distributed) without"
     "(?: the)?(?: prior)?(?: express)? written permission", ""),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e", ""),
    ("gpl", "gpl", "gnu gpl", ""),
    ("lgpl", "lgpl", "gnu lgpl", ""),
    ("agpl", "agpl", "gnu agpl", ""),
    ("apache", "apache", "licen[cs]ed under(?: the)? apache", ""),
    ("cc", "creative commons", "creative commons(?: [a-z]+)? licen[cs]e", ""),
]

#: Sentences that stand in the licenses or their notices: label, keyword, pattern.
GRANTS = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use", "permission to use copy modify and/?~or distribute this software for any purpose with or "
     "without fee is hereby granted"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "endorse or promote", "neither the names? of .{1,200}? (?:may|nor) .{0,200}?endorse or promote products"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "warranties conditions", "distributed on an as is basis without warranties or conditions of any kind"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license"),
    ("gpl", "redistribute it", "you can redistribute it and/?~or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it", "you can redistribute it and/?~or modify it under the terms of the gnu lesser general "
     "public license"),
    ("agpl", "redistribute it", "you can redistribute it and/?~or modify it under the terms of the gnu affero general "
     "public license"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization "
     "obtaining a copy of the software and accompanying documentation"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of "
     "the eclipse public license"),
    ("gfdl", "distribute", "permission is granted to copy distribute and/?~or modify this document"),
    ("cc0", "waive", "has waived all copyright and related or neighbou?ring rights"),
    ("cc", "creative commons", "this work is licen[cs]ed under a creative commons"),
    ("public-domain", "disclaims copyright", "the author disclaims copyright to this source code"),
    ("beerware", "buy me a beer", "you can buy me a beer in return"),
    ("wtfpl", "you just do what", "you just do what the fuck you want to"),
]

WORD = "0-9a-z\x80-\xff"


def compiled(pattern: str) -> re.Pattern:
    """A signature's pattern over UTF-8 bytes read as Latin-1, between words."""
    gap = f"[^{WORD}]"
    source = pattern.replace("~", f"{gap}*").replace(" ", f"{gap}+")
    return re.compile(f"(?<![{WORD}])(?:{source})(?![{WORD}])", re.DOTALL)


def _version(version: str) -> str:
    """3.0 is also written 3."""
    major, _, minor = version.partition(".")
    rest = f"(?:[.]{minor})?" if minor == "0" else f"[.]{minor}"
    return f"{major}{rest}(?![.]?[0-9])"


def base_rule(label: str, phrase: str) -> Signature:
    """A phrase that is reported wherever its words stand one after the other."""
    return Signature(label, "base", re.escape(phrase).replace("\\ ", " "), phrase)


def default_rules() -> list[Signature]:
    """The built-in rules, the most specific kinds first."""
    rules = []
    later = "(?: or(?: at your option)?(?: any)? (?:later|newer)(?: versions?)?|~[+])"
    for family, keyword, name, short, url, versions in VERSIONED:
        for version in versions.split():
            label, v = f"{family}-{version}", _version(version)
            numbered = f"(?:~(?:version|ver[.]?|v[.]?))?~{v}"
            if name:
                rules.append(Signature(label, "name", name + numbered, keyword))
            if short:
                rules.append(Signature(label, "short", f"{short}(?:~licen[cs]e)?~v?~{v}", keyword))
            if "gpl" in family:
                rules.append(Signature(f"{label}-or-later", "name", f"{name or short + '~v?'}{numbered}{later}", keyword))
            if url:
                known = label if "{v}" in url or " " not in versions else family
                rules.append(Signature(known, "url", url.replace("{v}", v), url.split("[")[0]))
        if name:
            rules.append(Signature(family, "plain", name, keyword))
    for label, name, short in CREATIVE:
        for version in CREATIVE_VERSIONS.split():
            v = _version(version)
            rules += [
                Signature(f"{label}-{version}", "name", f"creative commons {name}(?: international| unported)?(?: licen[cs]e)?"
                          f"(?: version)?~{v}", "creative commons"),
                Signature(f"{label}-{version}", "short", f"cc {short} {v}", "cc by"),
                Signature(f"{label}-{version}", "url", f"creativecommons[.]org/licenses/{short.replace(' ', '-')}/{v}",
                          "creativecommons")]
        rules += [Signature(label, "plain", f"creative commons {name}", "creative commons"),
                  Signature(label, "plain", f"cc {short}", "cc by")]
    rules.append(Signature("cc0-1.0", "url", "creativecommons[.]org/publicdomain/zero/1[.]0", "creativecommons"))
    rules += [Signature(label, "plain", name, keyword) for label, keyword, name, _ in PLAIN]
    rules += [Signature(label, "grant", text, keyword) for label, keyword, text in GRANTS]
    tags = {spdx for *_, spdx in PLAIN if spdx} | {r.label for r in rules if r.kind in ("name", "short")}
    rules += [Signature(tag, "tag", f"spdx license identifier~:~{re.escape(tag)}(?![.+-]?[0-9a-z+])", "spdx")
              for tag in sorted(tags)]
    known = dict.fromkeys(rules)
    return sorted(known, key=lambda r: -KINDS[r.kind][0])


class Scanner:
    """The rules, ready to run on UTF-8 bytes that are lower-cased."""

    def __init__(self, rules: list[Signature]):
        self.rules = rules
        self.patterns = [compiled(r.pattern) for r in rules]
        self.needs = [frozenset(r.keywords.split()) for r in rules]
        self.by_keyword: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i, keywords in enumerate(self.needs):
            self.by_keyword.setdefault(max(sorted(keywords), key=len), []).append(i)
            for keyword in keywords:
                self.automaton.add_word(keyword, keyword)
        self.automaton.make_automaton()
        self.gate = "|".join(re.escape(k) for k in sorted(self.by_keyword))

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, end, rule)`` of the detections that stay, in text order."""
        present = {keyword for _, keyword in self.automaton.iter(text)}
        found = []
        for keyword in present:
            for i in self.by_keyword.get(keyword, ()):
                if self.needs[i] <= present:
                    found += [(m.start(), m.end(), i) for m in self.patterns[i].finditer(text)]
        return self.settled(found)

    def settled(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Detections without those within others of the same or a higher priority; of equal ones the
        first rule's stays.  Base rules always stay."""
        kinds = [KINDS[r.kind][0] for r in self.rules]
        found.sort(key=lambda d: (d[0], -d[1], -kinds[d[2]], d[2]))
        reach = dict.fromkeys(sorted(set(kinds)), -1)
        stay = []
        for start, end, rule in found:
            priority = kinds[rule]
            if self.rules[rule].kind == "base" or all(reach[p] < end for p in reach if p >= priority):
                stay.append((start, end, rule))
            reach[priority] = max(reach[priority], end)
        return stay


@cache
def _scanner(rules: tuple[Signature, ...]) -> Scanner:
    return Scanner(list(rules))


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where a word begins: a run of ASCII digits and letters and of all other characters."""
    inside = _IS_WORD[data]
    inside[1:] &= ~_IS_WORD[data[:-1]]
    return inside


def scan_licenses(docs: DataFrame, rules: list[Signature] | None = None) -> DataFrame:
    """``docs`` with ``n_words`` and ``licenses``: the detections that stay, in text order, as ``label,
    rule, kind, confidence, start, end`` (code points), ``first_word`` (its place, from 0).

    Words are runs of ASCII digits and letters and of characters beyond ASCII.  Null and empty texts
    have no words and no detections.  Of equal intervals and priorities the rule that stands first is
    reported; repeated rows are scanned each; columns of the names of results are replaced.  An empty
    table gives no rows.
    """
    rules = tuple(default_rules() if rules is None else rules)
    names = ["n_words", "licenses"]
    docs = docs.drop(*names)

    def detections(data: np.ndarray, starts: np.ndarray, scanner: Scanner) -> list[tuple]:
        found = scanner(data.tobytes().decode("latin-1"))
        if not found:
            return []
        words = np.flatnonzero(starts)
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        out = []
        for start, end, i in found:
            rule = scanner.rules[i]
            out.append((rule.label, rule.name, rule.kind, KINDS[rule.kind][1], int(characters[start]),
                        int(characters[end]), int(np.searchsorted(words, start, side="right")) - 1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in slices(batches):
            lower = pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
            gated = pc.match_substring_regex(lower, scanner.gate).to_numpy(zero_copy_only=False)
            counts, found = [], []
            for text, hit in zip(lower, gated.tolist()):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                starts = word_starts(data)
                counts.append(int(starts.sum()))
                found.append(detections(data, starts, scanner) if hit else [])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
            flat = list(zip(*(d for f in found for d in f))) or [[]] * len(fields)
            licenses = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                [pa.array(column, kind) for column, (_, kind) in zip(flat, fields)], [n for n, _ in fields]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), licenses], [*batch.schema.names, *names])

    fields = [("label", pa.string()), ("rule", pa.string()), ("kind", pa.string()), ("confidence", pa.float64()),
              ("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64())]
    added = StructType.fromDDL(
        "n_words long, licenses array<struct<label:string,rule:string,kind:string,confidence:double,start:long,"
        "end:long,first_word:long>>")
    return docs.mapInArrow(run, StructType(docs.schema.fields + added.fields))


def summary(scanned: DataFrame) -> DataFrame:
    """Of ``scan_licenses``: ``n_base, first_word, last_word`` of the base phrases' places, sorted
    distinct ``base_labels`` and ``labels``, and ``score``, the strongest detection's confidence."""
    base = F.filter("licenses", lambda d: d["kind"] == "base")
    places = F.transform(base, lambda d: d["first_word"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(
        F.transform(found, lambda d: d["label"]))), ",")
    return scanned.select(
        *[c for c in scanned.columns if c != "licenses"],
        F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda d: d["confidence"])), F.lit(0.0)).alias("score"))
