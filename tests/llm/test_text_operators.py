"""Operators on single texts: pseudonyms, byte-level BPE, page text, quality, fingerprints."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from veilscan.llm import byte_bpe, fingerprints, nbsvm, page_text, pseudonyms

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, ids string, score string, found string"


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(1)
    alphabet = [chr(c) for c in [*range(1, 0x180), 0x4E2D, 0x1F600, 0x301, 0x200D, 0x3000, 0x85, 0x660]]
    made = ["".join(chance.choice(alphabet if i % 2 else "abeinthr ' st\n\t") for _ in range(chance.randint(0, 80)))
            for i in range(300)]
    return [*made, "", None, "the" * 40_000, "a" * 20_000, " \n", made[3], made[3]]


def docs(spark, texts):
    """Rows whose other columns have the names of results."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


# -- pseudonyms -------------------------------------------------------------------------------

def pseudonymized(spark, texts, key="k"):
    out = pseudonyms.pseudonymize(docs(spark, texts), key, found="found")
    return {r.doc_id: (r.text, [tuple(p) for p in r.found]) for r in out.collect()}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def test_pseudonyms_keep_format_and_link(spark):
    card = "4785380592391139"
    out = pseudonymized(spark, [
        f"a {card}$$ b", f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", "4785380592391138",
        "call +1 (743) 555-3824, now", "+1 (743) 555-3825", "at 152.143.123.131### 256.1.1.1 1.2.3.4.5",
        "born 2024-02-29 or 31.12.1999", "2023-02-30 31.04.2020", "ssn 123-45-6789 000-45-6789",
        "that.92@mail2.example.com", "THAT.92@mail2.example.com,", "no value 4.0. here", "", None,
        "x.y_" * 20_000 + "@ex.com", f"{card} " * 3_000])
    made = out[0][1][0][1]
    assert luhn(made) and made != card and made[0] == "4" and out[0][0] == f"a {made}$$ b"
    assert out[1][0].replace(" ", "") == made
    assert out[2] == ("4785380592391138", [])
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}, now", out[3][0]) and out[3][0] != out[4][0]
    assert len(out[5][1]) == 1 and out[5][0].endswith("### 256.1.1.1 1.2.3.4.5")
    assert all(0 <= int(o) < 256 for o in out[5][1][0][1].split("."))
    assert [k for k, _ in out[6][1]] == ["date", "date"] and out[7] == ("2023-02-30 31.04.2020", [])
    assert len(out[8][1]) == 1 and out[8][0].endswith(" 000-45-6789")
    assert out[9][1] == out[10][1] and out[9][0].endswith("@mail2.example.com")
    assert out[11] == ("no value 4.0. here", []) and out[12] == ("", []) and out[13] == (None, [])
    assert out[14][0].endswith("@ex.com") and len(out[15][1]) == 3_000
    assert out[15][0] == f"{made} " * 3_000
    assert pseudonymized(spark, [card], "other")[0][0] != made


def test_phones_in_common_forms(spark):
    forms = ["+14155552671", "+4915112345678", "+33 1 23 45 67 89", "020 7946 0958", "415 555 2671",
             "+1 (415)555-2671", "+1 415 555 2671", "+49 (0)151/12345678", "+44.20.7946.0958", "01 23 45 67 89",
             "0151-12345678", "(020) 7946 0958", "+1234567", "+123456789012345", "(415)555-2671", "415.555.2671"]
    out = pseudonymized(spark, [f"call {f}, now" for f in forms])
    for i, form in enumerate(forms):
        text, found = out[i]
        assert [k for k, _ in found] == ["phone"] and form not in text, form
        assert text == f"call {found[0][1]}, now" and re.sub("[0-9]", "0", found[0][1]) == re.sub("[0-9]", "0", form)
    digits = lambda i: re.sub("[^0-9]", "", out[i][1][0][1])
    assert digits(0) == digits(5) == digits(6) and digits(0)[0] == "1"
    assert out[1][1][0][1].startswith("+49") and out[2][1][0][1].startswith("+33 ")
    # What follows a number keeps its kind; what has too few or too many digits is none.
    after = pseudonymized(spark, [
        "+1 (743) 555-3824 152.143.123.131", "+44 20 7946 0958 2024-01-02", "+14155552671 4785380592391139",
        "+123456", "+1234567890123456", "01.13.2024 2023-02-30 000-45-6789", "12 345 6789", "4155552671"])
    assert [[k for k, _ in after[i][1]] for i in range(8)] == [
        ["phone", "ip"], ["phone", "date"], ["phone", "card"], [], [], [], [], []]
    # 15 digits that pass the card checksum are a phone number after a plus.
    assert luhn("378282246310005")
    made = pseudonymized(spark, ["+378282246310005", "378282246310005"])
    assert [made[i][1][0][0] for i in range(2)] == ["phone", "card"]


def test_ibans(spark):
    def check(iban):
        iban = iban.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97

    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19",
             "FR1420041010050500013M02606", "NO9386011117947", "MT84MALT011000012345MTLCAST001S", "BE68 5390 0754 7034"]
    out = pseudonymized(spark, [*(f"to {i} EUR" for i in ibans), "DE88370400440532013000", "DE8937040044053201300"])
    for i, iban in enumerate(ibans):
        text, [(kind, made)] = out[i]
        assert kind == "iban" and check(iban) == check(made) == 1 and made != iban and made[:2] == iban[:2]
        assert text == f"to {made} EUR"
        kinds = lambda x: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x))
        assert kinds(made) == kinds(iban)
    assert out[0][1][0][1] == out[1][1][0][1].replace(" ", "")
    assert out[7] == ("DE88370400440532013000", []) and out[8][1] == []


def test_pseudonyms_are_a_permutation(spark):
    numbers = [f"{i:03d}" for i in range(1000)]
    out = spark.createDataFrame([(n,) for n in numbers], "n string").select(
        pseudonyms.permute_string(pseudonyms.F.col("n"), "t", "k").alias("n")).collect()
    assert sorted(r.n for r in out) == numbers
    empty = pseudonyms.pseudonymize(docs(spark, []), "k")
    assert empty.count() == 0 and empty.columns[-1] == "pii"


# -- byte-level BPE ---------------------------------------------------------------------------

def test_bpe_equals_the_public_library_and_round_trips(spark, texts):
    import tiktoken

    ranks = byte_bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
    encoded = byte_bpe.encode(docs(spark, texts), RANKS, public_tokenizers.PATTERN)
    assert encoded.columns[-1] == "ids" and encoded.columns.count("ids") == 1
    rows = byte_bpe.decode(encoded, RANKS).collect()
    at_once = byte_bpe.encode_and_decode(docs(spark, texts), RANKS, public_tokenizers.PATTERN)
    assert sorted(map(str, at_once.collect())) == sorted(map(str, rows))
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text)
        assert row.decoded == text
    assert byte_bpe.encode(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_transducer_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 50)
    monkeypatch.setattr(byte_bpe, "WINDOW", 64)
    ranks = byte_bpe.load_ranks(RANKS)
    transducer = byte_bpe.BpeTransducer(ranks)
    chance = random.Random(2)
    for _ in range(20):
        data = "".join(chance.choice("aetnhio") for _ in range(500)).encode()
        found = np.frombuffer(transducer.encode(data), np.int32).tolist()
        assert found == [ranks[p] for p in transducer.merge(data)]


def test_streaming_decoder_keeps_split_characters():
    data = "aé中😀z".encode()
    for size in (1, 2, 3):
        stream = byte_bpe.Utf8Stream()
        parts = [stream.feed(data[i:i + size]) for i in range(0, len(data), size)]
        assert "".join(parts) + stream.close() == data.decode()
    stream = byte_bpe.Utf8Stream()
    assert stream.feed(b"a\xff") + stream.close() == "a�"


# -- page text --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def field():
    return page_text.train()


def test_pages_held_out(field):
    pages = page_text.labelled_pages(150, seed=77)
    right = sum(field.viterbi(field.scores(blocks)) == labels for blocks, labels in pages)
    assert right >= 0.95 * len(pages)
    blocks = pages[0][0]
    plain = [sum(field.weights.get(f, 0.0) for f in field.features(b)) for b in blocks]
    assert np.allclose(field.scores(blocks), plain)


@pytest.mark.parametrize("third", range(3))
def test_layout_families_held_out(third):
    def held_out(layout):
        return zlib.crc32(layout.encode()) % 3 == third

    field = page_text.train(use=lambda layout: not held_out(layout))
    pages = page_text.labelled_pages(150, seed=78, use=held_out)
    right = [a == b for blocks, labels in pages for a, b in zip(field.viterbi(field.scores(blocks)), labels)]
    assert sum(right) >= 0.85 * len(right)


@pytest.mark.parametrize("page, expected", [
    ("<p data-x=it's>It is, one.</p><p>It's two.</p>", ["It is, one.", "It's two."]),
    ('<p title="abc>one</p><p class="x">two</p>', ["two"]),
    ('<p>one</p><p title="abc>two</p>', ["one"]),
    ("<p a=\"x>y\" b='>' c = d>one</p>", ["one"]),
    ("<a href=/x/>one</a> two<title-bar>three</title-bar>", ["one two", "three"]),
    ("<svg/><p>one<!-->two<!-- x --!>three</p>", ["onetwothree"]),
    ("<script type='a>b'>x</script foo>one", ["one"]),
    ("<p =a=b / c>one<br/>two", ["one two"]),
    ("a < b <3 c", ["a < b <3 c"]),
])
def test_broken_attributes(page, expected):
    assert [b.text for b in page_text.leaf_blocks(page)] == expected


def test_deep_pages_take_linear_time(field):
    for page in ("<b>" * 20_000 + "x" + "</i>" * 20_000, "<p a='" * 20_000, "<!--" * 20_000,
                 "".join(f"<div class=c{i}>text {i}" for i in range(20_000))):
        start = time.process_time()
        page_text.main_text(page, field)
        assert time.process_time() - start < 5


def test_all_text_against_a_plain_parser():
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        silent, text = 0, ""

        def handle_starttag(self, tag, attrs):
            self.silent += tag in page_text.SILENT

        def handle_endtag(self, tag):
            self.silent -= tag in page_text.SILENT

        def handle_data(self, data):
            self.text += "" if self.silent else data

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"])["html"].to_pylist()
    for page in pages:
        plain = Plain()
        plain.feed(page or "")
        plain.close()
        found = "".join(b.text for b in page_text.leaf_blocks(page or ""))
        assert "".join(found.split()) == "".join(plain.text.split())


def test_viterbi_and_marginals_against_all_labelings(field):
    import itertools

    chance = random.Random(4)
    for size in (1, 2, 5):
        scores = [chance.uniform(-3, 3) for _ in range(size)]

        def weight(labels, scores=scores):
            return (field.first[labels[0]] + sum(s * y for s, y in zip(scores, labels))
                    + sum(field.pairs[a, b] for a, b in zip(labels, labels[1:])))

        every = list(itertools.product((0, 1), repeat=size))
        assert tuple(field.viterbi(scores)) == max(every, key=weight)
        total = sum(np.exp(weight(y)) for y in every)
        single, _ = field._marginals(scores)
        expected = sum(np.exp(weight(y)) for y in every if y[0]) / total
        assert abs(single[0, 1] - expected) < 1e-9
    assert field.viterbi([]) == []


def test_extraction(spark, field):
    long = "word " * 20_000
    pages = [
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav>"
        "<article><h1>A &amp; B</h1><p>One\n two,   three and four.<br>five<p>Six<!-- no --> &lt;seven&gt; and more words."
        "<script>var t = '</p>';</script></p></article>"
        '<section class="comments"><p>I do not agree with this at all.</p></section><footer>&copy; x</footer>',
        None, "", "<p", "plain words without any markup, but enough of them to be read as text.",
        f"<article><p>{long}</p></article>", "<nav><a>x</a></nav>", "</div></p><b>"]
    pages += pages[:1]
    df = spark.createDataFrame([(i, p, "old") for i, p in enumerate(pages)], "page_id long, html string, text string")
    rows = {r.page_id: r for r in page_text.with_length(page_text.extract(df, field)).collect()}
    assert rows[0].text == ("A & B\nOne two, three and four. five\nSix <seven> and more words.")
    assert rows[0].n_chars == len(rows[0].text)
    assert rows[1].text == rows[2].text == rows[6].text == rows[7].text == "" and rows[1].n_chars == 0
    assert rows[5].text == long.strip() and rows[8].text == rows[0].text
    assert page_text.extract(df.limit(0), field).count() == 0


# -- quality ----------------------------------------------------------------------------------

def quality_rows():
    chance = random.Random(6)
    rows = []
    for i in range(400):
        words = ["".join(chance.choice("aeitnsrl") for _ in range(chance.randint(2, 8))) for _ in range(40)]
        good = chance.random() < 0.8
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, int(good)))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = quality_rows()
    table = spark.createDataFrame(
        [(i, t, "a", "b") for i, t, _ in rows] + [(1000, "", "a", "b"), (1001, None, "a", "b"),
                                                (None, "x " * 50_000, "a", "b")],
        "doc_id long, text string, score string, lang string")
    labels = spark.createDataFrame(
        [(i, q) for i, _, q in rows] + [(None, 1), (5000, 1), (1, None)], "doc_id long, quality int")
    model = nbsvm.fit(table, labels)
    out = nbsvm.score(table, model).withColumn("fold", nbsvm.fold(nbsvm.F.col("doc_id"))).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 for r in out)
    truth = {i: q for i, _, q in rows}
    held = [r for r in out if r.fold == 0 and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) for r in out)
    assert nbsvm.score(table.limit(0), model).count() == 0


def test_quality_reads_long_runs_whole(spark):
    chance = random.Random(21)
    word = lambda: "".join(chance.choice("aeitnsrl") for _ in range(6))
    good = ["".join(word() for _ in range(11))[:64] + " " + " ".join(word() for _ in range(30)) for _ in range(60)]
    bad = ["".join(word() for _ in range(11))[:64] + " " + "BUY99!!#" * 24 for _ in range(60)]
    model = nbsvm.train([t for pair in zip(good, bad) for t in pair], np.array([1, 0] * 60))
    # The same start of 64 characters; what follows tells them apart, though no run has been seen.
    start = "".join(word() for _ in range(11))[:64]
    texts = [start + "".join(word() for _ in range(60)), start + "BUY99!!#" * 100]
    scores = {r.doc_id: r.score for r in nbsvm.score(docs(spark, texts), model).select("doc_id", "score").collect()}
    assert scores[0] > 0.5 > scores[1]
    indicators = nbsvm.Indicators()
    assert set(indicators("!!??" * 16).tolist()) <= set(indicators("a" * 64 + "!!??" * 16).tolist())


def test_quality_keeps_few_words():
    """Tables of words stay small, and what falls out of them changes no feature."""
    indicators = nbsvm.Indicators()
    texts = [" ".join(f"w{i}x{j}" for j in range(1_000)) for i in range(320)]
    for text in texts:
        indicators(text)
    assert len(indicators.kept) + len(indicators.older) <= 210_000
    assert (indicators(texts[0]) == nbsvm.Indicators()(texts[0])).all()


def test_quality_without_labels_or_with_one_class(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in nbsvm.score(table, nbsvm.fit(table, none)).collect()] == [0.5, 0.5]
    one = nbsvm.train(["a b", "c"], np.array([1, 1]))
    assert one.scores(np.array([0.0]))[0] > 0.99


def test_dual_descent_solves_the_hinge_problem():
    chance = np.random.default_rng(1)
    points = chance.normal(size=(60, 3))
    labels = (points @ np.array([1.0, -2.0, 0.5]) > 0).astype(float)
    rows = [np.arange(3)] * 60
    weights, bias = nbsvm.dual_coordinate_descent(rows, list(points), labels, 3, cost=10.0, epochs=500)
    assert (((points @ weights + bias) > 0) == (labels > 0)).mean() >= 0.98


# -- fingerprints -----------------------------------------------------------------------------

def plain_counts(data, n):
    counts = np.zeros(n, int)
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32
        h ^= h >> 15
        counts[h * 0x85EBCA77 % 2**32 >> 32 - (n.bit_length() - 1)] += 1
    return counts


def test_fingerprint_counts_and_likeness(monkeypatch):
    data = random.Random(8).randbytes(3_000)
    assert (fingerprints.bucket_counts(data) == plain_counts(data, 1024)).all()
    monkeypatch.setattr(fingerprints, "_BLOCK", 100)
    assert (fingerprints.bucket_counts(data) == plain_counts(data, 1024)).all()
    a, b = fingerprints.digest(data), fingerprints.digest(data[:1500] * 2)
    assert fingerprints.likeness([a, a], [a, b])[0] == 1.0
    assert 0 <= fingerprints.likeness([a], [b])[0] < 1
    assert fingerprints.likeness([], []).size == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_next_documents(spark, parts):
    chance = random.Random(9)
    texts = ["".join(chance.choice("abcdé 😀") for _ in range(chance.randint(0, 60))) for _ in range(40)]
    rows = [(7 * i - 50, t) for i, t in enumerate(texts)] + [(6, "twice"), (6, "twice b"), (500, None), (None, "no id")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, key string")
    found = fingerprints.compare_with_next(df.repartition(3), parts).collect()
    ordered = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    expected = []
    for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        t, following = t or "", following or ""
        edited = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(),
                         fingerprints.digest(t.encode()).hex()))
    got = [(r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), r.fingerprint) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    one = fingerprints.compare_with_next(df.where("doc_id = 500"), parts).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(500, 1.0)]
    assert fingerprints.compare_with_next(df.limit(0), parts).count() == 0
    assert fingerprints.fingerprint(df).where("fingerprint is null").count() == 0
