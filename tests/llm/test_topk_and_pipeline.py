"""Exact top-k search, and the pipeline against a plain version of itself."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import byte_bpe, language_id, queries, topk_search

from test_native import brute as brute_lines
from test_native import mixed_by_hand
from test_ngram_join import brute as brute_join


def plain(rows, k=5, scale=256, every=50):
    """(query, rank, id, score) by comparing everything."""
    usable = [(i, np.floor(scale * np.asarray(v, "f8")).astype(np.int64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    sizes = [len(v) for _, v in usable]
    usual = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if sizes else 0
    usable = [(i, v) for i, v in usable if len(v) == usual]
    out = []
    for q, x in usable:
        if q % every == 0:
            found = sorted((-int(x @ v), i) for i, v in usable if i != q)[:k]
            out += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(found)]
    return sorted(out)


def search(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0, k).collect())


@pytest.mark.parametrize("kind", ["spread", "clustered", "copies", "few"])
def test_top_k_against_brute_force(spark, kind, monkeypatch):
    dice = np.random.default_rng(11)
    monkeypatch.setattr(topk_search, "BLOCK", 150)
    n = {"few": 4}.get(kind, 900)
    x = dice.normal(0, 0.2, (n, 12))
    if kind == "clustered":
        x = dice.normal(0, 1, (9, 12))[dice.integers(0, 9, n)] + x * 0.1
    if kind == "copies":
        x[dice.random(n) < 0.4] = x[0]
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(5000, None), (5050, [0.1] * 11 + [float("nan")]), (5100, [0.1] * 11 + [None]), (5150, [1.0, 2.0]), (None, [0.1] * 12), (5200, []), (5250, [0.5] * 11 + [float("inf")])]
    assert search(spark, rows) == plain(rows)


def test_top_k_edges(spark):
    assert search(spark, []) == [] and search(spark, [(0, None)]) == []
    assert search(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], 1) == [(0, 1, 1, 65536)]


def test_top_k_of_components_beyond_32_bits(spark):
    rows = [(0, [1e7, 0.0]), (1, [0.5, 1.0]), (2, [-0.5, 2.0]), (50, [0.25, 0.0]), (100, [0.0, 1.0]), (3, [-1e7, 0.0])]
    assert search(spark, rows, 3) == plain(rows, 3)
    x = np.asarray([[2**31, -(2**31) - 5], [2**40, 7]])
    assert (np.sort(topk_search.CoverTree.unpack(topk_search.CoverTree(x, np.arange(2)[:, None]).pack()).points, axis=0) == np.sort(x, axis=0)).all()


def test_top_k_in_rounds_and_without_pairs_of_blocks(spark, monkeypatch, capfd):
    dice = np.random.default_rng(5)
    monkeypatch.setattr(topk_search, "BLOCK", 60)
    monkeypatch.setattr(topk_search, "ROUND_BYTES", 2000)
    x = dice.normal(0, 1, (7, 6))[dice.integers(0, 7, 800)] + dice.normal(0, 0.05, (800, 6))
    rows = [(i * 10, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(i, v) for i, v in rows[:200]]  # repeated rows
    rows += [(rows[0][0], [float(np.float32(v)) for v in x[99]])]  # an id with two vectors
    best = {}
    for q, _, i, s in plain(rows, 2000):
        best[q, i] = max(best.get((q, i), s), s)
    wanted = []
    for q in sorted({q for q, _ in best}):
        found = sorted((-s, i) for (a, i), s in best.items() if a == q)[:5]
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert search(spark, rows) == wanted
    plans = []
    meet = topk_search._meet
    monkeypatch.setattr(topk_search, "_meet", lambda *a: plans.append(meet(*a)) or plans[-1])
    search(spark, rows)
    assert len(plans) > 4 and not any("Join" in p._jdf.queryExecution().toString() for p in plans)


def test_bounds_prune_clustered_data_and_nothing_is_lost():
    dice = np.random.default_rng(6)
    centers = dice.normal(0, 400, (20, 16))
    data, asked = ((centers[dice.integers(0, 20, n)] + dice.normal(0, 9, (n, 16))).astype(np.int64) for n in (2000, 300))
    tree = topk_search.CoverTree(data, np.arange(2000)[:, None])
    queries_ = topk_search.CoverTree(asked, np.arange(5000, 5300)[:, None])
    best, seen = topk_search.Best.of(300, 5), []
    topk_search.search(queries_, tree, best, seen)
    scores = queries_.points @ data.T
    for i in range(300):
        assert best.ids[i].tolist() == np.lexsort((np.arange(2000), -scores[i]))[:5].tolist()
    assert sum(seen) < 0.4 * scores.size


def test_scores_of_any_size_are_exact_or_refused(spark):
    big = 3e7  # scores near 2 ** 57
    rows = [(0, [big, 1.0]), (1, [big, 1.0 + 2**-8]), (2, [big, 1.0 - 2**-8]), (50, [-big, 0.5])]
    rows = [(i, [float(np.float32(x)) / 16 for x in v]) for i, v in rows]
    assert search(spark, rows, 3) == plain(rows, 3)
    with pytest.raises(Exception, match="64 bits|2 \\*\\* 62"):
        search(spark, [(0, [1e17, 0.0]), (1, [1e17, 0.0])])


def test_cover_trees_cover():
    x = np.random.default_rng(4).normal(0, 60, (700, 8)).astype(np.int64)
    tree = topk_search.CoverTree(x, np.arange(700)[:, None])
    again = topk_search.CoverTree.unpack(tree.pack())
    for node, (begin, end) in enumerate(tree.span):
        far = np.sqrt(((tree.points[begin:end] - tree.at[node]) ** 2).sum(axis=1))
        assert far.max() <= tree.reach[node] + 1e-9
        assert not tree.children[node] or sorted(tree.span[c] for c in tree.children[node])[0][0] == begin and sum(tree.span[c][1] - tree.span[c][0] for c in tree.children[node]) == end - begin
    assert again.span == tree.span and again.children == tree.children and (again.ids == tree.ids).all() and sorted(tree.order) == list(range(700))


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    dice = random.Random(21)
    pools = {"en": "the of and to in is that fox dog house river stone walks sings slowly".split(), "fr": "le la des et un est que renard chien maison pierre marche chante lentement".split()}
    docs = []
    for i in range(90):
        lang = dice.choice(["en", "fr"])
        lines = [" ".join(dice.choice(pools[lang]) for _ in range(dice.randint(3, 14))) for _ in range(dice.randint(2, 9))]
        docs.append([i, "\n".join(lines), lang, dice.choice(["s1", "s2", "s3", None])])
    passage = " ".join(dice.choice(pools["en"]) for _ in range(60))
    for i in (5, 17, 40):
        docs[i][1] += "\n" + passage
    docs[60][1] = docs[3][1]
    docs[8][1] = "\n".join(" ".join(dice.choice(pools["en"]) for _ in range(7)) for _ in range(11))
    words = docs[8][1].replace("\n", " \n ").split(" ")
    words[len(words) // 2] = "changed"
    docs[70][1] = " ".join(words).replace(" \n ", "\n")
    docs += [[900, None, "en", "s1"], [901, "", "en", "s1"], [902, "12 34", "en", "s2"], [903, "\n\n", None, None]]
    return [(*d, len(d[1]) if d[1] is not None else None) for d in docs]


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = language_id.learn(docs)
    kept = [r for r in rows if (p := language_id.classify(model, r[1]))[0] != "und" and p[1] >= language_id.LEAST_SCORE]
    assert len(kept) > 80 and all(r[0] < 900 for r in kept)
    cut = brute_lines([(r[0], r[1]) for r in kept], 50)
    texts = [(r[0], cut[r[0], r[1]]) for r in kept]
    texts = [(i, t) for (i, t), r in zip(texts, kept, strict=True) if t == r[1] or t.strip()]
    joined = brute_join(texts, corpus_pipeline.WORDS, Fraction(4, 5))
    texts = {i: t for i, t in texts if joined[i][1] == i}
    assert 60 not in texts and 70 not in texts
    source = {r[0]: r[3] for r in rows}
    sizes, target = mixed_by_hand([(i, t, source[i]) for i, t in texts.items()])
    ranks = byte_bpe.Vocabulary.read(public_tokenizers.path(queries.BPE_FILE)).ranks
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    times, taken = {}, {}
    for r in got:
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.n_chars == len(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        taken[r.source] = taken.get(r.source, 0) + len(texts[r.doc_id].split())
    assert max(times.values()) <= 2 and set(taken) == set(sizes)
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(len(t.split()) for t in texts.values())


def test_every_stage_but_the_last_keeps_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0), docs.limit(5).unionByName(docs.limit(5))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == COLUMNS and out.count() >= 0


def test_repeated_rows_leave_one_after_the_join(spark, tmp_path):
    docs = spark.createDataFrame([r for r in corpus()[:10]] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.keep_one_of_near_duplicates(spark, docs, str(tmp_path)).count() == 10
