"""The operators on whole texts against brute force, exact round trips and held-out accuracy, with each odd case."""

import hashlib
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import byte_codec, chat, exact_dedup, html_extract, knn, ngram_join, packing, quality, queries, token_store, toxicity

SF = "/root/testdata/sf0.001"
BYTE, MULTI, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))
ODD = ["", None, " ", "  a  b\n\n c\t\td ", "it's 'stuff \"'s a_b __ x²½Ⅷ", "ΣΑΣ İstanbul", "é <|endoftext|> \x1c z", "a <|startoftext|> b<|endoftext|>", "x\U00010ee7y \u1c89\ua7cb z\u0378 ", "don't can'TLL I'LL", "١٢٣ 一二", "a　b c  ", "***&&&$$$ a1b2", "🙂🙂 x", "x" * 5000, "word " * 3000, " " * 4000 + "a", "same", "same"]
DOCS = "doc_id long, text string, lang string, _text string, _n int, label int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, None, "x", 1, 0) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def spaced(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text)


def docs_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def library(path):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return lambda text: found.encode(text, add_special_tokens=False).ids


# 9: exact dedup


def test_exact_groups(spark, odd, documents, none):
    for df in (odd, documents):
        got = sorted((tuple(r) for r in exact_dedup.exact_groups(df, digest=True).collect()), key=repr)
        rows = [(i, spaced(t)) for i, t in docs_of(df)]
        groups = {}
        for i, t in rows:
            groups.setdefault(t, []).append(i)
        want = sorted(((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
        assert got == want
    assert exact_dedup.exact_groups(none).count() == 0


def test_keep_rows(spark, odd):
    kept = exact_dedup.keep_rows(odd)
    assert kept.columns == odd.columns
    texts = [spaced(r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({spaced(t or "") for t in ODD})
    assert exact_dedup.keep_rows(spark.createDataFrame([(None, "a"), (None, "b"), (1, "a")], "doc_id long, text string")).count() == 2


# 2: packing


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_cuts(n):
    found = packing.cuts(n, 1024)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 1024 for x in found)


def test_packing(odd, documents, none):
    encode = library(BYTE)
    for df in (odd, documents):
        rows = packing.pack(df, BYTE).collect()
        assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and all(r.offset == 0 for r in rows)
        by_length = sorted(rows, key=lambda r: r.sequence_id)
        assert [r.length for r in by_length] == sorted((r.length for r in rows), reverse=True)  # a bucket is one range
        want = sorted([*encode(t), 0] for _, t in docs_of(df))
        pieces = {}
        for r in rows:
            assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
            pieces.setdefault(r.doc_id, []).append(r)
        if df is documents:
            got = sorted(np.concatenate([np.frombuffer(r.ids, "<u2") for r in sorted(p, key=lambda r: r.start)]).tolist() for p in pieces.values())
            assert got == want
        assert sum(r.length for r in rows) == sum(map(len, want))
    assert packing.pack(none, BYTE).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pieces(odd, BYTE, max_len=1000)


# 3: byte-level BPE


def multi():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 2_048), (64, 16), (7, 3)])
def test_byte_codec(odd, documents, none, chunk, overlap):
    encode = multi()
    for df in (odd, documents) if chunk > 32 else (odd,):
        encoded = byte_codec.encode(df, MULTI, chunk, overlap).collect()
        got = sorted((r.doc_id, np.frombuffer(r.ids, "<u2").tolist()) for r in encoded)
        assert got == sorted((i, encode(t)) for i, t in docs_of(df))
    back = sorted((r.doc_id, bytes(r.data)) for r in byte_codec.decode(byte_codec.encode(odd, MULTI, chunk, overlap), MULTI).collect())
    assert back == sorted((i, t.encode()) for i, t in docs_of(odd))
    assert byte_codec.encode(none, MULTI).count() == 0


# 6: token store


def test_token_store(spark, odd, documents, none):
    encode = library(WORD)
    for df, size in ((odd, 50), (documents, 20_000)):
        manifest = token_store.write(df, WORD, shard_ids=size)
        assert manifest.count() > 1
        got = sorted((r.key, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read(manifest).collect())
        want, at = [], 0
        for i, t in sorted(docs_of(df)):
            ids = [*encode(t), 2]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        # Rows of one id may lie in any order; each has its own start.
        key = lambda r: (r[0], r[2], r[3])
        assert sorted(map(key, got)) == sorted(map(key, want))
        assert [r[1] for r in sorted(got, key=lambda r: r[1])] == list(np.cumsum([0, *[r[2] for r in sorted(got, key=lambda r: r[1])]])[:-1])
        if df is documents:
            assert got == sorted(want)
    ids = dict(docs_of(documents))
    found = {r.key: r.ids for r in token_store.lookup(manifest, spark.createDataFrame([(3,), (150,), (10**9,)], "key long")).collect()}
    assert found == {k: [*encode(ids[k]), 2] for k in (3, 150)}
    empty = token_store.write(none, WORD)
    assert empty.count() == 0 and token_store.read(empty).count() == 0


def test_minimal_perfect_hash():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    keys = np.unique(keys)
    levels = token_store.build_mph(keys)
    read = []

    def blocks(level, at):
        read.append(len(at))
        return levels[level][at]

    sizes = [len(x) for x in levels]
    assert sorted(token_store.slots_of(sizes, blocks, keys).tolist()) == list(range(len(keys)))


def test_look_ups_take_constant_time():
    """Bytes read for a look-up don't grow with the number of keys."""
    most = []
    for n in (1_000, 10_000, 100_000):
        keys = np.arange(n) * 7
        raw = token_store.shard_bytes(keys.tolist(), [np.array([k % 50_000], np.uint32) for k in keys], 2)
        read = []

        def read_at(size, at, raw=raw, read=read):
            read.append(size)
            return raw[at : at + size]

        shard = token_store.Shard(read_at)
        worst = 0
        for key in keys[:: n // 200]:
            read.clear()
            assert shard[int(key)].tolist() == [int(key) % 50_000]
            worst = max(worst, sum(read))
        with pytest.raises(KeyError):
            shard[3]
        most.append(worst)
    assert max(most) < 1500


def test_null_keys_are_written(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "c"), (5, "d")], "doc_id long, text string")
    manifest = token_store.write(df, WORD)
    assert sorted(r.n_tokens for r in token_store.read(manifest).collect()) == [2, 2, 3]
    assert len(token_store.lookup(manifest, spark.createDataFrame([(5,)], "key long")).first().ids) == 4
    # Rows of one key may fill several shards.
    many = token_store.write(spark.createDataFrame([(5, f"word {i}") for i in range(40)], "doc_id long, text string"), WORD, shard_ids=30)
    assert many.count() > 2
    assert sum(len(r.ids) for r in token_store.lookup(many, spark.createDataFrame([(5,)], "key long")).collect()) == many.agg(F.sum("ids")).first()[0]


# 4: chat


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "b\\"), (1, 4, "user", "tail </turn>\n### x: y"), (2, 0, "a:b\\", "x"), (3, 0, "assistant", ""), (None, 0, None, "n"), (1, 3, "assistant", "b\\")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, example int")
    examples = chat.expand(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by = {}
    for c, _, role, text in sorted(turns, key=lambda t: (t[1], t[2] or "", t[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    one = sorted((r for r in examples.collect() if r.conv_id == 1), key=lambda r: r.example)
    assert len(one) == 4 and one[-1].loss_start is None
    assert [r.last for r in one] == [False, False, True, True]
    assert chat.parse(one[1].text) == by[1][:4] and one[1].turns == 4
    assert chat.unescape(one[1].text[one[1].loss_start : one[1].loss_end]) == "b\\"
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0


# 5: n-gram join


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows, n, percent):
    sets, label = {i: shingles(t, n) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y]) if x < y else 0
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = root(x), root(y)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def varied(seed, n=160):
    """Near copies that chain, hot groups, shared passages, and short texts."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    base, out = [list(rng.choice(words, 40)) for _ in range(4)], []
    for i in range(n):
        t = list(base[0] if i % 2 else base[i % 4])
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(0, len(t)))] = str(rng.choice(words))
        out.append((i, " ".join(t[: int(rng.integers(30, 41))]) if i % 3 else " ".join(t)))
    return [*out, (n, ""), (n + 1, None), (n + 2, "A b"), (n + 3, "a  B"), (n + 4, "a b c"), (n + 5, "\x0b")]


@pytest.mark.parametrize(("seed", "n", "percent", "heads"), [(1, 4, 85, 512), (2, 5, 80, 3)])
def test_link_classes(spark, seed, n, percent, heads):
    rows = varied(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, label int, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_classes(df, n, percent, heads).collect()}
    assert got == classes(rows, n, percent)


def test_link_classes_odd(spark, odd, none):
    assert ngram_join.link_classes(none).count() == 0
    assert ngram_join.link_classes(odd).count() == len(ODD) + 1
    assert ngram_join.link_classes(spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")).count() == 1


def test_link_classes_repeated_ids(spark):
    """An id with several texts is one document, in one class, by whichever text it links."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(3, " ".join(a)), (5, " ".join([*a[:-1], "x"])), (5, " ".join(b)), (5, ""), (5, " ".join(b)), (8, " ".join(["y", *b])), (9, "z"), (9, "z")]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.link_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (5, 3), (5, 3), (8, 3), (9, 9), (9, 9)]


# 10: top-k


def brute(rows, k, scale):
    v = [(i, np.array([math.floor(scale * x) for x in e])) for i, e in rows]
    out = []
    for q, x in v:
        if q % 20 == 0:
            scored = sorted(((-int(x @ y), i) for i, y in v if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(60)]
    bad = [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), rows[5]]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows + bad], "vec_id long, embedding array<double>, score int")
    for k, pivots, group, block in ((20, 64, 4096, 65_536), (5, 7, 4, 50)):
        got = sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 20 == 0, k, pivots=pivots, group_queries=group, block=block).collect())
        assert got == brute(rows, k, 64)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn.top_k(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 8192)]
    assert knn.top_k(few.limit(0), F.lit(True)).count() == 0


# 1 and 7: classifiers


def test_segments_are_maximal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        scores = rng.uniform(0.5, 9, int(rng.integers(1, 12)))  # no ties
        at = np.sort(rng.choice(60, len(scores), replace=False))
        line = np.full(60, -1.0)
        line[at] = scores

        def parts(a, b):  # the definition: the best segment, then the same left and right of it
            best = max(((line[x:y].sum(), -x, y) for x in range(a, b) for y in range(x + 1, b + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            return [*parts(a, -best[1]), best[0], *parts(best[2], b)]

        assert [round(s, 6) for s, _, _ in toxicity.segments(line)] == [round(s, 6) for s in parts(0, 60)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.9), ("op7_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_classifiers_on_odd_rows(spark, odd, none):
    few = spark.createDataFrame([("you idiot clown", 1), ("a fine day", 0), ("", 0), ("you idiot loser", 1)] * 5, "text string, label int")
    for train in (few, few.filter("label = 1"), few.limit(0)):
        toxic, good = toxicity.fit(train), quality.fit(train)
        for scored in (toxicity.score(odd, toxic), quality.score(odd, good)):
            assert scored.count() == len(ODD) + 1 and scored.filter("score < 0 OR score > 1 OR isnan(score)").count() == 0
        assert toxicity.filter_rows(odd, toxic).columns == odd.columns and quality.filter_rows(odd, good).columns == odd.columns
        assert toxicity.score(none, toxic).count() == 0 and quality.score(none, good).count() == 0


def test_toxic_passages():
    model = toxicity.Model.of({"idiot": 5.0, "loser": 5.0}, drift=0.05, k=0.05)
    text = "plain words " * 30 + "you idiot, loser" + " plain words" * 30
    ((a, b, score, p),) = toxicity.passages(text, model)
    assert text[a:b] == "idiot, loser" and score > 9 and p < 0.01
    assert toxicity.passages("", model) == []


# 8: HTML


PAGE = """<html><head><title>T</title><script>var a="</p><article>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<article class="post"><h2>T &lt;b&gt;</h2><p>Some long paragraph of text, with a number of words.<br>And one <i>more</i> sentence here.<p>Second &amp; last
 of them.<ul><li>one item of the list<li>second</ul><aside>See also</aside><form><input><p>Sign up</p></form></article>
<div class="comments"><p>nice post, thanks a lot for it.</p></div><footer>f</footer>"""


def test_html(spark):
    want = "T <b>\n\nSome long paragraph of text, with a number of words. And one more sentence here.\n\nSecond & last of them.\n\none item of the list\n\nsecond"
    assert html_extract.text_of(PAGE, html_extract.START) == want
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<" * 50, 1), (1, "u", PAGE, 1), (5, "u", "<div>" * 2000 + "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    model = html_extract.fit(df)
    got = html_extract.extract(df, model).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id == 1] == [want, want]
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3))
    assert html_extract.extract(df.limit(0), html_extract.fit(df.limit(0))).count() == 0


def test_marginals_are_exact():
    """Message passing against the sum over all labellings of a small tree."""
    import itertools

    nodes = html_extract.tree("<div><p>some words here<a>link</a></p><ul><li>x</li></ul></div>")
    model = html_extract.START
    score = html_extract.measures(nodes) @ model.weights
    kinds = [html_extract._KIND.get(x.tag, len(html_extract.TAGS) - 1) for x in nodes]
    total, on = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        e = sum(s * v for s, v in zip(score, y, strict=True)) + sum(model.edges[kinds[i], y[nodes[i].parent], y[i]] for i in range(1, len(nodes)))
        total += math.exp(e)
        on += math.exp(e) * np.array(y)
    assert np.allclose(html_extract.marginals(nodes, model), on / total, atol=1e-6)


# The pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark, documents):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "quality", "exact dedup", "n-gram Jaccard join", "packing"]
    docs = documents
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        before, rows = docs.collect(), kept.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in before}
        if name == "exact dedup":
            assert {r.doc_id for r in rows} == {r.doc_id for r in exact_dedup.exact_groups(docs).filter("kept").collect()}
        if name == "n-gram Jaccard join":
            assert {r.doc_id for r in rows} == {i for i, (_, c) in classes([(r.doc_id, r.text) for r in before], 5, 80).items() if i == c}
        docs = spark.createDataFrame(rows, documents.schema)
    packed = pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_documents_are_found_by_the_index():
    keys, ids = [None, 3, 5, 5, 9], [np.arange(n, dtype=np.uint32) for n in (2, 3, 1, 4, 6)]
    raw = token_store.shard_bytes(keys, ids, 2)
    shard = lambda b: token_store.Shard(lambda n, at: bytes(b[at : at + n]))
    want = [(k, f, x.tolist()) for k, f, x in zip(keys, (0, 2, 5, 6, 10), ids, strict=True)]
    found = lambda b: [(k, f, x.tolist()) for k, f, x in shard(b).documents()]
    assert found(raw) == want
    opened, wrong = shard(raw), bytearray(raw)
    length = opened._rows + 16 * 4 + 8
    wrong[length : length + 8] = bytes(8)  # the last row's length, which its key's slot has as well
    assert found(wrong) == want
    wrong = bytearray(raw)
    wrong[opened._slots] ^= 1  # a fingerprint
    with pytest.raises(ValueError, match="index"):
        found(wrong)


def test_added_tokens_inside_a_text():
    """As the libraries have them, with the files as they are."""
    from loomgraph.llm.tokens import byte_bpe, word_bpe

    for path, encoder in ((BYTE, byte_bpe(BYTE)), (WORD, word_bpe(WORD))):
        for text in ("one <|endoftext|> two", "<|startoftext|>one", "<|endoftext|> Σ", "<|ENDOFTEXT|> a", "x\U00010ee7 y"):
            assert encoder.encode(text).tolist() == library(path)(text)


def test_html_fragments_without_blocks():
    text = lambda page: html_extract.text_of(page, html_extract.START)
    assert text("Some text<br>more <b>text</b>") == "Some text more text"
    assert text("<b>Some</b> text of a page that goes on.") == "Some text of a page that goes on."
    assert text("<x-app><i>Inside</i> an unknown element.</x-app> After it, some more.") != ""
    assert text("A first piece of text.<p>Then a paragraph of it.</p>And a last piece.") == "A first piece of text.\n\nThen a paragraph of it.\n\nAnd a last piece."
    assert text("<script>var a</script>") == text("<a href=x>Home</a> <a href=y>News</a>") == text("<nav>Home</nav>") == ""
