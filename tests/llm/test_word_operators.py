"""Operators on words and phrases: spelling variants, license scans, periodic runs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from veilscan.llm import licenses, periodic_runs, queries, spelling
from veilscan.llm.licenses import KINDS, Signature, base_rule

DOCS = "doc_id long, text string, n_words string, runs string, licenses string, n string"


def docs(spark, rows):
    """Rows whose other columns have the names of results."""
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS)


def query(spark, tmp_path, rows, run):
    docs(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return run(spark, str(tmp_path))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- spelling ---------------------------------------------------------------------------------

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(counts):
    rows, form = {}, {}
    for word, n in counts.items():
        others = sorted(((-m, w) for w, m in counts.items() if near(word, w)))
        top = -others[0][0] if others else None
        if others and top >= 10 * n and top > n:
            form[word] = others[0][1]
        rows[word] = [n, len(others), form.get(word), top if word in form else None]
    for word, row in rows.items():
        last = word
        while last in form:
            last = form[last]
        row.append(last)
    return rows


def test_variants_equal_all_pairs(spark):
    chance = random.Random(3)
    counts = {}
    for _ in range(250):
        word = "".join(chance.choice("abß") for _ in range(chance.randint(1, 7)))
        counts[word] = chance.choice([1, 2, 9, 10, 20, 100, 100, 1000, 20_000])
    counts |= {"x" * 300: 5, "x" * 299: 500, "x" * 301: 2, "x" * 150 + "y" * 150: 3, "x" * 150 + "y" * 151: 30,
               "x" * 150 + "z" + "y" * 150: 30, **{c * 63 + "k": 4 for c in "ab"}, "a" * 64 + "k": 50, "a" * 65: 50, "a" * 64: 7, "yz😀": 3, "yz": 30, "y😀": 300, "yé😀": 30}
    rows = [(w, n, "x", "y") for w, n in counts.items()] + [(None, 4, "x", "y"), ("", 9, "x", "y"),
                                                            ("q" + spelling.TERMINATOR, 3, "x", "y")]
    out = spelling.variants(spark.createDataFrame(rows, "word string, n long, form string, best string"))
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    got = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in out.collect()}
    assert got.pop(None) == [4, 0, None, None, None]
    assert got.pop("") == [9, 0, None, None, ""] and got.pop("q" + spelling.TERMINATOR)[1] == 0
    assert got == plain_variants(counts)
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(empty, 9)


def test_long_chains_of_forms(spark):
    """Every step adds a letter and ten times the count."""
    chain = {"a" * (i + 1): 2 * 10 ** i for i in range(18)}
    out = spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long"))
    assert {r.root for r in out.collect()} == {"a" * 18}


def test_spelling_query_equals_brute_force(spark, tmp_path):
    chance = random.Random(4)
    base = ["government", "environment", "mountains", "Straßenbahn", "GOVERNMENT", "gouvernement", "éÉ×÷ÀÿÞxy", "short"]
    rows = [(i, " ".join(chance.choice(base) + chance.choice(["", "s", ".", "1", "'"]) for _ in range(60)))
            for i in range(300)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[1][1]), (None, None), (500, None), (501, ""),
             (502, "mountains " * 30_000), (503, "z" * 2_000 + " " + "z" * 2_000)]
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = query(spark, tmp_path, rows, queries.op11_spelling_variants)
    got = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in out.collect()}
    assert got == plain_variants(counts) and any(r[2] for r in got.values())
    empty = query(spark, tmp_path, [], queries.op11_spelling_variants)
    assert empty.count() == 0 and dict(empty.dtypes) == {
        "word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


# -- licenses ---------------------------------------------------------------------------------

def plain_scan(text, rules):
    """Every rule over the whole text; suppression by comparing all detections."""
    data = text.encode().lower().decode("latin-1")
    found = [(m.start(), m.end(), KINDS[r.kind][0], i) for i, r in enumerate(rules)
             for m in licenses.compiled(r.pattern).finditer(data)]
    stay = []
    for d in found:
        within = [e for e in found if e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]
                  and (e[:3] != d[:3] or e[3] < d[3])]
        if rules[d[3]].kind == "base" or not within:
            stay.append(d)
    return sorted((rules[i].name, s, e) for s, e, _, i in stay)


LICENSE_TEXTS = [
    "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License,\n  Version 2.0 (the \"License\")",
    "GNU\nLesser   General Public License v2.1 or any later version", "gplv3+, LGPL 2.1, AGPL-3.0-or-later",
    "SPDX-License-Identifier: Apache-2.0", "// spdx-license-identifier: bsd-3-clause",
    "https://www.gnu.org/licenses/gpl-3.0.html and https://creativecommons.org/licenses/by-sa/4.0/",
    "Permission is hereby granted,\nfree of charge, to any person obtaining a copy of this software",
    "Redistribution and use in source and binary forms, with or without\n# modification, are permitted",
    "mit licenses", "submit license", "MITé License", "mit · license", "cc  by cc/by cc_by ccby", "er kam mit dem",
    "apache license apache license APACHE-LICENSE", "Creative Commons Attribution-ShareAlike 4.0 International License",
    "1234 äö \U0001f600 cc by", "the gnu general public license " * 50, "BSD 3-Clause, simplified BSD license",
    "mozilla public license 2.0 MPL 1.1 EPL-2.0 EUPL 1.2", "", " ", "License", "gpl 2.05 gpl 2", "GNU GPL",
]


def test_licenses_equal_ungated_scan(spark):
    rules = licenses.default_rules() + [base_rule(*p) for p in queries.LICENSE_PHRASES]
    assert len(rules) > 500 and len({r.label for r in rules}) > 150
    chance = random.Random(6)
    mixed = [" ".join(chance.choice(LICENSE_TEXTS) for _ in range(3)) for _ in range(25)]
    texts = [*LICENSE_TEXTS, *mixed, mixed[0], None]
    out = licenses.scan_licenses(docs(spark, enumerate(texts)), rules).collect()
    assert len(out) == len(texts) and out[0].runs == "b"
    for row in out:
        text = row.text or ""
        words = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
            c.lower() if c.isascii() else c for c in text)))
        assert row.n_words == len(words), text
        starts = [m.start() for m in words]
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).tolist()
        got = sorted((d.rule, at[d.start], at[d.end]) for d in row.licenses)
        assert got == plain_scan(text, rules), text
        assert all(starts[d.first_word] == d.start for d in row.licenses if d.kind == "base")
    labels = lambda i: {d.label for d in out[i].licenses}
    assert labels(0) == {"mit"} and labels(1) == {"gpl", "gpl-3.0"} and labels(2) == {"cc-by", "cc-by-nc-4.0"}
    assert labels(3) >= {"apache", "apache-2.0"} and labels(4) == {"lgpl-2.1-or-later"}
    assert labels(5) == {"gpl-3.0-or-later", "lgpl-2.1", "agpl-3.0-or-later"} or "agpl-3.0" in labels(5)
    assert labels(6) == {"apache-2.0"} and labels(7) == {"bsd-3-clause"}
    assert labels(8) == {"gpl-3.0", "cc-by-sa-4.0"} and labels(9) == {"mit"} and labels(10) == {"bsd"}
    assert not labels(11) and not labels(12) and not labels(13) and not labels(14 + 2)


def test_keywords_are_parts_of_every_match():
    """Literals of each rule's keywords stand in its pattern, so the gate loses nothing."""
    for rule in licenses.default_rules():
        plain = re.sub(r"\[cs\]", "c", rule.pattern).replace("[.]", ".").replace("\\", "")
        american = re.sub(r"\[cs\]", "s", rule.pattern).replace("[.]", ".").replace("\\", "")
        assert all(k in plain or k in american for k in rule.keywords.split()), rule
    assert not licenses.Scanner([Signature("a", "plain", "x y", "x")])("y x")


def test_license_scans_go_on_past_the_first_piece_of_a_batch(spark, tmp_path):
    # No text is null: a column with nulls is copied by the fill, and no piece begins within a buffer.
    rows = [(i, f"The MIT License, no. {i}") for i in range(1_200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_license_scans(spark, str(tmp_path)).where(
        "n_words = 5 AND n_base = 1 AND first_word = 1 AND last_word = 1 AND base_labels = 'mit'")
    assert out.count() == len(rows)


def test_license_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(LICENSE_TEXTS)] + [
        (90, None), (91, "x " * 40_000 + "MIT  License." + " cc by" * 20_000), (None, "cc by"), (3, LICENSE_TEXTS[3]),
        (92, "y" * 300_000 + "-" * 100_000 + " apache" + "-" * 50_000 + "license")]
    out = query(spark, tmp_path, rows, queries.op12_license_scans).collect()
    assert len(out) == len(rows)
    expected = []
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        places = [(at, label) for label, phrase in queries.LICENSE_PHRASES for at in range(len(words))
                  if words[at:at + len(phrase.split())] == phrase.split()]
        starts = [at for at, _ in places]
        expected.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None),
                         ",".join(sorted({label for _, label in places}))))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=key) == (
        sorted(expected, key=key))
    for r in out:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and (r.score > 0) == bool(r.labels)
    assert query(spark, tmp_path, [], queries.op12_license_scans).count() == 0


# -- runs -------------------------------------------------------------------------------------

def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    chance = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(chance.randint(1, 6)):
            letters, text = chance.choice([1, 2, 2, 3, 5, 30]), []
            while len(text) < chance.randint(0, 120):
                if chance.random() < 0.5:
                    text += [chance.randrange(letters) for _ in range(chance.randint(1, 8))] * chance.randint(1, 9)
                else:
                    text += [chance.randrange(letters + 20) for _ in range(chance.randint(1, 12))]
                if chance.random() < 0.2:
                    text += text[-chance.randint(1, len(text)):]
            texts.append(text)
        words = np.array([w for t in texts for w in t], np.int64)
        found = periodic_runs.runs_of(words, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
        assert [found.get(i, []) for i in range(len(texts))] == [plain_runs(t) for t in texts]


def test_places_stay_sorted():
    chance, places, known = random.Random(8), periodic_runs.Places(500_000), [500_000]
    for x in chance.sample(range(500_000), 9_000):
        before, after = places.put(x)
        assert before == max((k for k in known if k < x), default=-1) if len(known) < 300 else before < x
        assert after == min((k for k in known if k > x), default=-1) if len(known) < 300 else after > x
        known.append(x)
    assert list(places) == sorted(known)


def test_runs_query_equals_brute_force(spark, tmp_path):
    chance = random.Random(7)
    rows = [(i, " ".join(chance.choice("a b c c d e f".split(" ")) + chance.choice(["", "\n", "\t"])
                         for _ in range(chance.randint(0, 150)))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, "x " * 50), (303, "from " * 30_000), (5, rows[5][1]),
             (304, "  a " * 8), (305, "w" * 100_000), (306, " ".join(f"u{i}" for i in range(30_000)))]
    out = query(spark, tmp_path, rows, queries.op13_periodic_runs).collect()
    expected, repeated = [], 0
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
            repeated += 1
        runs = plain_runs(words) if n < 1000 else ([(0, n, 1)] if i == 303 else [])
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        expected.append((i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                         sha("".join("%d,%d,%d\n" % r for r in runs)),
                         sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert repeated > 15
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in out]
    assert sorted(got, key=key) == sorted(expected, key=key)
    empty = query(spark, tmp_path, [], queries.op13_periodic_runs)
    assert empty.count() == 0 and dict(empty.dtypes)["exponent_milli"] == "bigint"


def test_runs_keep_other_columns(spark):
    out = periodic_runs.find_runs(docs(spark, [(1, "a b a b a b a b a b"), (None, None)]))
    assert out.columns == ["doc_id", "text", "licenses", "n", "n_words", "runs", "collapsed"]
    first, second = sorted(out.collect(), key=lambda r: -r.n_words)
    assert first.collapsed == "a b" and [tuple(r) for r in first.runs] == [(0, 10, 2)]
    assert second.collapsed == "" and second.runs == [] and second.n_words == 0
