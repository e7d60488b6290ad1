"""Further cases: hostile input, clashing names, second implementations, and the pipeline's stages on odd rows."""

import hashlib
import math
import os
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import byte_codec, chat, exact_dedup, html_extract, knn, packing, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


# 1: toxicity


def naive_odds(counts, prior):
    """Log-odds by the definition, with a dictionary of all prefixes: {word: (toxic, clean)}."""
    sums, after = {}, {}
    for w, (t, c) in counts.items():
        for k in range(len(w) + 1):
            a, b = sums.get(w[:k], (0, 0))
            sums[w[:k]] = (a + t, b + c)
            after.setdefault(w[:k], set()).add(w[k] if k < len(w) else "")
    kept = sorted((p for p in sums if p == "" or len(after[p]) > 1), key=len)
    share = {}
    for p in kept:
        t, c = sums[p]
        up = next((p[:k] for k in range(len(p) - 1, -1, -1) if p[:k] in share), None)
        share[p] = (t + 1) / (t + c + 2) if up is None else (t + prior * share[up]) / (t + c + prior)
    logit = lambda p: math.log(p / (1 - p)) - math.log(share[""] / (1 - share[""]))

    def odds(word):
        up = next(word[:k] for k in range(len(word), -1, -1) if word[:k] in share)
        if word not in counts:
            return logit(share[up])
        t, c = counts[word]
        return logit((t + prior * share[up]) / (t + c + prior))

    return odds


def best_parts(x):
    """Maximal segments by the definition: the best one, then the same left and right of it."""
    best = max(((sum(x[a:b]), -a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0, 0, 0))
    return [] if best[0] <= 0 else [*best_parts(x[: -best[1]]), best[0], *best_parts(x[best[2] :])]


def test_toxicity_by_brute_force(spark):
    """Every score again, from counts to calibration, by plain definitions."""
    rng = np.random.default_rng(7)
    words = [a + b for a in ("calm", "day", "vile", "scum", "sun") for b in ("", "s", "ing", "er")]
    weights = {1: np.array([1] * 8 + [4] * 8 + [1] * 4), 0: np.array([4] * 8 + [0.2] * 8 + [4] * 4)}
    rows = [(" ".join(rng.choice(words, int(rng.integers(1, 18)), p=weights[y] / weights[y].sum())), y) for y in rng.integers(0, 2, 120).tolist()]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"), prior=8.0, drift=1.5)
    counts = {}
    for text, y in rows:
        for w in set(text.split()):
            t, c = counts.get(w, (0, 0))
            counts[w] = (t + y, c + 1 - y)
    odds = naive_odds(counts, 8.0)
    texts = [t for t, _ in rows[:40]] + ["", "Vile SCUMMY calmest zzz", "unknown words only"]
    want = {}
    for i, text in enumerate(texts):
        found = re.findall(r"\w+", text)
        parts = best_parts([odds(w.lower()) - model.drift for w in found])
        ps = [-math.expm1(-model.k * len(found) * math.exp(-model.scale * s)) for s in parts]
        x = (min(-math.log10(min(ps)), 20), math.log1p(sum(p <= 0.01 for p in ps))) if ps else (0, 0)
        want[i] = 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * x[0] + model.weights[2] * x[1])))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_extreme_value_law_is_found_again():
    rng = np.random.default_rng(2)
    n = rng.integers(20, 2000, 20_000).astype(float)
    best = (np.log(0.05 * n) + rng.gumbel(size=len(n))) / 1.7
    scale, k = toxicity.extreme_value(best, n)
    assert abs(scale - 1.7) < 0.05 and abs(k - 0.05) < 0.01


# 2, 9, 10: skew, nulls and names


def test_pack_null_and_repeated_ids(spark):
    rows = [(None, "a b c")] * 30 + [(1, "same")] * 30 + [(2, None)] * 30
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    got = packed.collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert "row" not in packed.columns and {r.doc_id for r in got} == {None, 1, 2}


def test_keep_rows_with_clashing_names(spark):
    names = ["_own", "_first", "_id", "_sha", "_n", "_p", "_keep", "_rows"]
    rows = [(1, "a  b", *names), (2, "a b", *names), (3, "c", *names), (3, "c", *names), (None, "d", *names), (None, "d", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = exact_dedup.keep_rows(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)
    assert exact_dedup.keep_rows(df.limit(0)).count() == 0


def test_hot_copies_and_full_hash_only_where_needed(spark):
    rows = [(i, "viral text") for i in range(3000)] + [(3000 + i, f"own {i}") for i in range(2000)]
    groups = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    got = groups.groupBy("keep_id").agg(F.count("*").alias("n"), F.max("group_size").alias("size"), F.count("text_sha256").alias("hashed")).filter("n > 1").collect()
    assert [tuple(r) for r in got] == [(0, 3000, 3000, 3000)]
    far = exact_dedup.exact_groups(spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "doc_id long, text string"))
    assert far.filter("text_sha256 IS NOT NULL").count() == 0


def test_top_k_with_common_factors_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i * 64, [float(x) for x in rng.normal(size=4)]) for i in range(200)] + [(0, [1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 1280 == 0, 3, block=20).collect()
    v = [(i, np.array([math.floor(64 * x) for x in e])) for i, e in rows if i is not None]
    best = {}
    for q, x in v:
        if q % 1280 == 0:
            best.setdefault(q, []).extend((-int(x @ y), i) for i, y in v if i != q)
    for q in best:
        if q:  # an id with several vectors asks with each of them
            assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in sorted(best[q])[:3]]


# 3: digests, and texts that engines cut otherwise


def test_digests_of_long_texts_with_recent_letters(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["plain words  of a long text\n\n " * 3000, "a\U00010ee7b \u1c89x" * 8000, "x \xa0y\t" * 9000, "一二三 " * 12_000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in byte_codec.digests(byte_codec.encode(df, path), path).collect()}
    for i, t in enumerate(texts):
        ids = encode(t)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


# 4: chat


@needs_data
def test_op4_holds_the_given_conversation(spark):
    got = {r.conv_id: r for r in queries.op4_chat(spark, SF).collect()}
    said = r"\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(said)
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    by = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert set(got) == {*by, -7}
    for c, turns in by.items():
        loss = "".join(t for _, role, t in sorted(turns) if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_without_replies_is_handed_on_in_batches(spark, monkeypatch):
    monkeypatch.setattr(chat, "_BATCH", 1000)
    rows = [(c, t, "user", "x" * 200) for c in range(50) for t in range(3)]
    examples = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert examples.count() == 50 and examples.filter("loss_start IS NOT NULL OR NOT last").count() == 0


# 7: quality


@needs_data
def test_quality_scores_by_plain_table_look_ups(spark):
    """Scores are sums of bins, whatever batch a text is in, and alike for repeated rows."""
    model = quality.fit(queries.taught(spark, SF, "quality"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    again = {r.doc_id: r.score for r in quality.score(docs.union(docs).repartition(7), model).collect()}
    assert once == again and len(set(once.values())) > 10


def naive_measures(t):
    words = t.split()
    if not words:
        return [0.0] * len(quality.MEASURES)
    n, chars = len(words), len(t)
    of = lambda letters: sum(c in letters for c in t)
    spaces, ends, counts = of(" \t\r"), of("\n"), sorted((words.count(w) for w in set(words)), reverse=True)
    lines = [x for x in t.split("\n") if x]
    short = sum(words.count(w) for w in set(words) if len(w) <= 3)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log(1 + chars), math.log(1 + n), (chars - spaces - ends) / n, of("#$%&*@^~=+\\_") / chars, of("|") / n, of(".,;:!?'\"-()") / chars, sum("A" <= c <= "Z" for c in t) / n, sum("0" <= c <= "9" for c in t) / chars,
        len(counts) / n**0.8, same / n, counts[0] / n, sum(counts[:3]) / n, 1 - len(set(lines)) / max(1, len(lines)), math.log(1 + n / max(1, len(lines))),
        math.log(1 + n / (1 + of(".!?"))), short / n, spaces / chars, of("{}[]<>") / chars,
    ]


@needs_data
def test_quality_by_brute_force(spark):
    """Every score of the table again: plain counts, a bin by counting edges, one addition for each table."""
    model = quality.fit(queries.taught(spark, SF, "quality"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.filter("n_chars < 4000").collect():
        bins = [sum(e <= v + 1e-12 * abs(v) for e in edges) for v, edges in zip(naive_measures(r.text or ""), model.edges, strict=True)]
        z = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-6
    assert len(got) == docs.count()


def test_tree_cuts_are_the_best_ones():
    rng = np.random.default_rng(5)
    g, h = rng.normal(size=9), rng.uniform(3, 9, 9)
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + 1)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    cut = max(range(1, 9), key=lambda k: gain(0, k) + gain(k, 9))
    assert np.allclose(quality._leaves(g, h, 1), [value(0, cut)] * cut + [value(cut, 9)] * (9 - cut))


# 8: HTML


@pytest.mark.parametrize("page", ["<a " * 64_000, "<b>" * 30_000 + "</i>" * 30_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000, "<div>" * 20_000 + "<td></td>" * 20_000, '<a "' * 60_001 + ">", "<!--" * 60_000], ids=["open", "nest", "barrier", "cells", "quotes", "comments"])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    html_extract.text_of(page, html_extract.START)
    assert time.perf_counter() - began < 10


@needs_data
def test_html_on_the_whole_table(spark):
    """Against a hand-written rule for the pages of this table: the article's blocks, but for its asides and forms."""
    from html.parser import HTMLParser

    blocks = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption div section".split())

    class Rule(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.skip, self.out, self.run = 0, [], [], []

        def end_block(self):
            text = " ".join("".join(self.run).split())
            self.run = []
            if text:
                self.out.append(text)

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside += 1
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            if self.inside and (self.skip or tag in ("aside", "form", "script", "style", "nav", "footer", "header") or set(re.findall("[a-z]+", named.lower())) & html_extract.NOT_CONTENT):
                if tag not in html_extract.VOID:
                    self.skip.append(tag)
            if tag in blocks:
                self.end_block()
            if tag == "br":
                self.run.append(" ")

        def handle_endtag(self, tag):
            if self.skip and tag == self.skip[-1]:
                self.skip.pop()
            if tag in blocks or tag == "article":
                self.end_block()
            if tag == "article":
                self.inside -= 1

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.run.append(data)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages, html_extract.fit(pages)).collect()}
    same = 0
    for r in pages.collect():
        rule = Rule()
        rule.feed(r.html or "")
        rule.end_block()
        same += got[r.page_id] == "\n\n".join(rule.out)
    assert len(got) == pages.count() and same >= 0.95 * len(got)


# SQL


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


# The pipeline


@needs_data
def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, clashing names, an empty table: each stage gives the columns that it got."""
    import corpus_pipeline as pipeline

    names = ["_other", "_first", "_id", "_sha", "_n", "sequence", "row", "label"]
    clean = " ".join(f"word{i}" for i in range(50))
    rows = [(1, clean), (2, clean), (3, clean + " more"), (None, clean), (None, None), (4, ""), (5, None), (5, None), (6, "x" * 20_000)]
    df = spark.createDataFrame([(*r, "en", "s", 1, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, df, SF)
        assert kept.columns == df.columns, name
        got = sorted((r.doc_id, r.text) for r in kept.filter("doc_id IS NOT NULL").collect()) if "dedup" in name or "join" in name else None
        if name == "exact dedup":
            assert [i for i, _ in got] == [1, 3, 4, 6]
        if name == "n-gram Jaccard join":
            assert [i for i, _ in got] == [1, 4, 5, 5, 6] and kept.filter("doc_id IS NULL").count() == 2
        assert stage(spark, df.limit(0), SF).count() == 0
    packed = pipeline.pack(spark, df, SF)
    assert packed.select("doc_id").distinct().count() == 7 and pipeline.pack(spark, df.limit(0), SF).count() == 0
