"""Operators on whole tables: neighbours, Jaccard join, URL filters, packing, chats, pipeline."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from veilscan.llm import chat, jaccard_join, neighbours, packing, url_filters
from veilscan.llm.components import components
from veilscan.llm.shingles import Shingler


# -- neighbours -------------------------------------------------------------------------------

def test_neighbours_against_brute_force(spark):
    random_ = np.random.default_rng(2)
    centres = random_.normal(size=(20, 16))
    vectors = np.concatenate([centres[i % 20] + 0.3 * random_.normal(size=16) for i in range(600)]).reshape(600, 16)
    vectors[10:40] = vectors[10]
    vectors *= random_.uniform(0.8, 1.2, size=(600, 1))
    vectors[10:40] = vectors[10]
    rows = [(i, [float(x) for x in v], "r") for i, v in enumerate(vectors)]
    odd = [(700, None, "r"), (720, [0.0] * 16, "r"), (740, [float("nan")] + [1.0] * 15, "r"),
           (760, [None] + [1.0] * 15, "r"), (None, [1.0] * 16, "r"), (780, [1.0] * 3, "r"), (800, [2.0] * 3, "r")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string")
    out = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, block_rows=250).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(out) == {*range(0, 600, 20), 780, 800} and len(out[780]) == 1
    hits = 0
    for query in range(0, 600, 20):
        found = sorted(out[query])
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[1:] for f in found] == sorted((f[1:] for f in found), key=lambda f: (-f[1], f[0]))
        scores = vectors @ vectors[query]
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in found) and query not in [f[1] for f in found]
        best = sorted((i for i in range(600) if i != query), key=lambda i: (-scores[i], i))[:20]
        hits += len(set(best) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * 30
    # Equal vectors have equal scores and come by number.
    equal = [i for _, i, _ in sorted(out[20]) if 10 <= i < 40]
    assert equal == sorted(equal) and len({s for _, i, s in out[20] if 10 <= i < 40}) <= 1
    assert neighbours.nearest(df.limit(0), df, 5).count() == 0


# -- Jaccard join -----------------------------------------------------------------------------

def plain_classes(rows):
    """Classes by comparing all pairs of texts."""
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[top(a)] = top(b)
    least = defaultdict(lambda: 1 << 60)
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min(least[top(i)], doc_id)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def near_copy_rows():
    chance = random.Random(12)
    word = lambda: "".join(chance.choice("aeinrst") for _ in range(5))
    line = " ".join(word() for _ in range(12))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(chance.choice([3, 5, 8, 30, 60, 200]))]
        texts.append(" ".join(words))
        for _ in range(chance.choice([0, 0, 1, 6])):
            copy = list(words)
            for _ in range(chance.choice([0, 1, 1, 2, 3])):
                copy[chance.randrange(len(copy))] = word()
            if chance.random() < 0.3:
                copy += [word() for _ in range(chance.randint(1, 8))]
            texts.append(" ".join(copy))
    texts += [f"{line} {' '.join(word() for _ in range(chance.randint(1, 30)))}" for _ in range(30)]
    # One hot group of near copies that only their original links.
    base = [word() for _ in range(100)]
    for _ in range(60):
        copy = list(base)
        for _ in range(chance.randint(1, 4)):
            copy[chance.randrange(100)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(base), " ".join(base).upper(), "\t".join(base), "", None, " \n", "one", "ONE", "one two",
              "w " * 30_000, "w " * 3]
    return [(1000 - i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block, part, crowd", [(1024, 1 << 13, 1 << 10), (7, 8, 4)])
def test_classes_equal_those_of_all_pairs(spark, monkeypatch, block, part, crowd):
    for name, value in (("BLOCK", block), ("PART", part), ("CROWD", crowd)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copy_rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, size string, node int")
    out = jaccard_join.near_duplicates(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == plain_classes(rows)


@pytest.mark.parametrize("large", [3, 1 << 20])
def test_tiles_hold_the_members_of_keys(monkeypatch, large):
    """Keys with the same members share a tile; large and dealt ones are tiles by themselves."""
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    chance = random.Random(2)
    for _ in range(200):
        rows = sorted({(-1, chance.randrange(-9, 9), chance.randrange(-20, 20)) for _ in range(chance.randint(0, 60))})
        rows = sorted([*rows, *chance.sample(rows, len(rows) // 3)])  # repeated entries
        rows += sorted((part, 99, node) for part, node in {(chance.randrange(2), chance.randrange(5)) for _ in range(4)})
        arrays = [np.array([r[i] for r in rows], np.int64) for i in (1, 0, 2)]
        size = chance.randint(1, 9)
        batches = [jaccard_join.pa.RecordBatch.from_arrays(
            [jaccard_join.pa.array(a[i:i + size]) for a in arrays], ["key", "part", "node"])
            for i in range(0, len(rows), size)]
        members, counts = defaultdict(set), {}
        for batch in jaccard_join._members_of_keys(iter(batches)):
            for tile, n, node in zip(*(c.to_pylist() for c in batch.columns)):
                members[tile].add(node)
                counts[tile] = n
        by_key = defaultdict(set)
        for _, key, node in rows:
            by_key[key].add(node)
        wanted = {frozenset(m) for k, m in by_key.items() if len(m) > 1 or k == 99}
        assert {frozenset(m) for m in members.values() if len(m) > 1} == {m for m in wanted if len(m) > 1}
        assert all(n is None or n == len(members[t]) for t, n in counts.items())
        assert all(counts[t] is None for t in counts if t == 99)


def test_classes_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (3, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert out == [(1, 1, 1), (1, 1, 1), (3, 0, 3), (None, 1, None)]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_numbers_shared_by_different_texts(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(5, " ".join(words)), (5, " ".join(words[::-1])), (6, " ".join([*words, "x"])), (7, "other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect())
    assert out == plain_classes(rows)


def test_signatures_never_overstate_the_difference():
    chance = np.random.default_rng(3)
    for _ in range(200):
        n, extra = int(chance.integers(1, 400)), int(chance.integers(0, 120))
        common = chance.integers(0, 2**63, n).astype(np.uint64)
        a = np.unique(np.concatenate([common, chance.integers(0, 2**63, extra).astype(np.uint64)]))
        b = np.unique(common)
        x, y = (np.frombuffer(jaccard_join.signature(s), np.uint64) for s in (a, b))
        width = min(len(x), len(y))
        different = int(np.bitwise_count(jaccard_join.fold(x, width) ^ jaccard_join.fold(y, width)).sum())
        assert different <= len(np.setxor1d(a, b))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert jaccard_join.may_link(len(a), len(b), different)


def test_shingles_of_words():
    shingles = Shingler()
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and not len(shingles(" \t"))
    assert (shingles("A b\x0bc") == shingles("a  B\nC")).all()
    assert len(shingles("É a b c d")) == 1 and (shingles("É a b") != shingles("é a b")).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 100), (150, 200), (7, 7)]
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {i: 0 for i in range(31)} | {100: 100, 150: 100, 200: 100}
    assert len(out) == 34
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- URL filters ------------------------------------------------------------------------------

RULES = [url_filters.UrlRule("block", "net", "/"), url_filters.UrlRule("allow", "example.net", "/en/")]


def test_rules_and_reputation(spark):
    urls = ["http://A.example.NET/en/1?q", "https://example.net/de", "https://example.net", "no host", None,
            "http://badexample.net/en/", "x://h.org?u=http://example.net/en/", "//a://Z.net/#f"]
    urls += ["http://bad.org/x"] * 30 + ["http://good.org/x"] * 30 + ["http://rare.org/x"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    outcomes = spark.createDataFrame(
        [(i, int(8 <= i < 38)) for i in range(8, 68)] + [(68, 1), (9999, 1), (10, None)], "page_id long, bad int")
    rows = {r.page_id: r for r in url_filters.filter_urls(pages, outcomes, RULES, limit=0.6).collect()}
    assert len(rows) == len(urls)
    assert [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(8)] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de", "net/", "block"),
        ("example.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("badexample.net", "/en/", "net/", "block"), ("h.org", "", None, "allow"), ("z.net", "/", "net/", "block")]
    assert rows[8].verdict == "block" and rows[40].verdict == "allow"
    # One bad page tells less than thirty.
    assert rows[40].bad_bound < rows[68].bad_bound < rows[8].bad_bound
    assert rows[40].bad_rate < rows[68].bad_rate < rows[8].bad_rate
    nothing = url_filters.filter_urls(pages, outcomes.limit(0), [])
    assert {r.verdict for r in nothing.collect()} == {"allow"}
    assert url_filters.filter_urls(pages.limit(0), outcomes, RULES).count() == 0


# -- packing ----------------------------------------------------------------------------------

def check_packed(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


@pytest.mark.parametrize("group", [50_000, 40])
def test_packing_is_gapless_and_tight(spark, group):
    chance = random.Random(15)
    rows = [(i // 2, i % 2, chance.choice([1, 5, 40, 64, chance.randint(1, 64)]), "s") for i in range(500)]
    rows += [(7, 0, 33, "s")] * 20
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, offset string")
    out = packing.pack(df, size=64, group_items=group).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in out) == sorted(r[:3] for r in rows)
    least = -(-sum(r[2] for r in rows) // 64)
    n_over_half = sum(r[2] > 32 for r in rows)
    assert check_packed(out, 64) <= 1.1 * max(least, n_over_half)
    assert packing.pack(df.limit(0), size=64).count() == 0


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    chance = random.Random(16)
    alphabet = [chr(c) for c in [*range(1, 0x250), 0x4E2D, 0x301, 0x3000, 0x2028, 0x1F600, 0x2019, 0x212A]]
    texts = ["".join(chance.choice(alphabet if i % 2 else "Abeinthr's t\n09") for _ in range(chance.randint(0, 60)))
             for i in range(200)] + ["", None, "word " * 9_000, "x" * 3_000, "<|endoftext|> a"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    pieces = defaultdict(list)
    for r in packing.cut_pieces(df, path).collect():
        pieces[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096))
        assert [r.length for r in own] == [min(4096, len(ids) - r.start) for r in own]
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes()
    assert zlib.crc32(bytes(pieces[200][0].ids)) == zlib.crc32(b"\x01\0\0\0")


def test_pieces_hold_added_tokens(spark):
    from tokenizers import Tokenizer

    from veilscan.llm.queries import pieces_of

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b É", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext",
             "word " * 5_000 + "<|endoftext|>\n\n" + "more " * 5_000, "no token"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {(r.doc_id, r.piece): r for r in pieces_of(df).collect()}
    expected = {}
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at:at + 4096]
            expected[i, piece] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {k: (r.start, r.length, r.ids_crc32) for k, r in out.items()} == expected


# -- chats ------------------------------------------------------------------------------------

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_escapes_are_reversible():
    template, chance = chat.Template(), random.Random(17)
    parts = ["<", "/s>", "</s>", "[", "INST] ", "[/INST]", "\\", "<<SYS>>", "<|", "role|>", "[ASST] ", " ", "a"]
    for _ in range(3_000):
        text = "".join(chance.choice(parts) for _ in range(chance.randint(0, 9)))
        escaped = template.escape(text)
        assert template.unescape(escaped) == text and not any(c in escaped for c in template.controls())


@pytest.mark.parametrize("parts", [1, 3])
def test_chats_read_back(spark, parts):
    chance, rows = random.Random(18), []
    for conv in range(40):
        turns = [("user", "same start"), ("assistant", "same answer")] if conv % 3 else []
        turns += [(chance.choice(["user", "assistant", "system", "tool</s>", "", None]),
                   chance.choice(["</s>[INST] ok", "é 😀", "", None, "x\\y", "long " * 500]))
                  for _ in range(chance.randint(0 if turns else 1, 4))]
        rows += [(conv, 10 * i, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(100, 0, "user", "same start"), (None, 0, "user", "no number"), (101, None, "user", "b"), (101, 1, "user", "a")]
    chance.shuffle(rows)
    df = spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    tree = chat.format_chats(df, VOCABULARY, n_parts=parts).persist()
    out = {r.conv_id: r for r in chat.read_chats(tree, VOCABULARY, n_parts=parts).collect()}
    known = defaultdict(list)
    for conv, turn, role, text in rows:
        known[conv].append((turn if turn is not None else -1, role or "", text or ""))
    assert set(out) == set(known)
    template = chat.Template()
    for conv, turns in known.items():
        turns = [t[1:] for t in sorted(turns)]
        assert [(t.role, t.text) for t in out[conv].turns] == turns
        assert out[conv].learnt == "".join(t for r, t in turns if r == "assistant")
        assert out[conv].formatted == "".join("".join(template.write(*t)) for t in turns)
    segments = defaultdict(list)
    for r in tree.where("role is not null").orderBy("part", "row").collect():
        segments[r.part].append(r)
    for part in segments.values():
        at = 0
        for r in part:
            assert r.start == at and r.length == len(r.tokens)
            assert sum(i.end - i.start for i in r.ancestors) == r.position
            assert all(i.end <= r.start for i in r.ancestors)
            at += r.length
    if parts == 1:
        paths = set()
        for turns in known.values():
            turns = [t[1:] for t in sorted(turns)]
            paths |= {tuple(turns[:i + 1]) for i in range(len(turns))}
        assert sum(len(p) for p in segments.values()) == len(paths)
    tree.unpersist()
    assert chat.format_chats(df.limit(0), VOCABULARY, n_parts=parts).count() == 0


# -- pipeline ---------------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    chance, rows, labels = random.Random(19), [], []
    for i in range(300):
        words = ["".join(chance.choice("aeitnsrl") for _ in range(chance.randint(2, 8))) for _ in range(40)]
        good = chance.random() < 0.8
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    good = next(r[1] for r, q in zip(rows, labels) if q[1])
    rows += [(400, good, "en", "s", 1), (401, good + " Write to ann.07@mail.example.com now.", "en", "s", 1),
             (402, good + " Words.", "en", "s", 1), (None, good, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).persist()
        if name != "best-fit packing":
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            kept.append({r.doc_id: r for r in docs.collect()})
    bad = {i for i, q, _ in labels if not q}
    assert len(bad & set(kept[0])) <= 3 and len(set(range(300)) - bad - set(kept[0])) <= 3
    plain = {(d, c) for d, _, c in plain_classes([(d, r.text) for d, r in kept[0].items() if d is not None])}
    assert set(kept[1]) - {None} == {d for d, c in plain if d == c} and 400 not in kept[1]
    assert set(kept[2]) == set(kept[1])
    assert not any("ann.07@" in r.text for r in kept[2].values())
    assert all(r.n_chars == len(r.text) for r in kept[2].values())
    assert {r.doc_id for r in docs.collect()} == set(kept[2])
    check_packed(docs.collect(), 4096)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in again) == sorted(
        (r.doc_id or -1, r.piece, r.ids_crc32) for r in docs.collect())


def test_near_duplicates_go_by_row(spark):
    import corpus_pipeline

    chance = random.Random(20)
    plain = [" ".join("".join(chance.choice("aeitnsrl") for _ in range(6)) for _ in range(40)) for _ in range(8)]
    rows = [(9, plain[0]), (None, plain[0]), (None, plain[1] + " near"), (10, plain[1]),
            (None, plain[2]), (None, plain[3]), (None, plain[3]),
            (5, plain[4]), (5, plain[5]), (3, plain[5] + " near"), (7, plain[6]), (7, plain[6]), (7, plain[6] + " near"),
            (None, ""), (None, None), (5, ""), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, df.repartition(3), "").collect()
    sevens = [r.text for r in out if r.doc_id == 7]
    assert len(sevens) == 1 and sevens[0] in (plain[6], plain[6] + " near")
    assert sorted((tuple(r) for r in out if r.doc_id != 7), key=str) == sorted(
        [(9, plain[0]), (10, plain[1]), (None, plain[2]), (None, plain[3]), (5, plain[4]),
         (3, plain[5] + " near"), (None, ""), (None, None), (5, ""), (6, "")], key=str)


def test_packing_leaves_no_words_in_workers(spark):
    """Workers live on after a task; words that it met must not stay in them."""
    path = public_tokenizers.path("word_bpe_49k.json")

    def held(batches):
        import pyarrow as pa

        from veilscan.llm import packing

        for batch in batches:
            known = packing._encoder.cache_info().currsize
            encoder = packing._encoder(path, True) if known else None
            words = known and len(encoder.kept) + len(encoder.older) + len(encoder.pieces) + len(encoder.older_pieces)
            yield pa.RecordBatch.from_pydict({"words": pa.array([words] * batch.num_rows, pa.int64())})

    df = spark.range(400).repartition(8).selectExpr("id AS doc_id", "concat('one two w', id) AS text")
    assert packing.cut_pieces(df, path, added_tokens=True).count() == 400
    assert spark.range(8).repartition(8).mapInArrow(held, "words long").agg({"words": "max"}).first()[0] == 0
