"""The n-gram Jaccard join against comparing all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

from corvane.llm import ngram_join as N
from corvane.llm import words as W

DOCS = "doc_id bigint, text string"


def shingles(text, n):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for part in w for x in part.replace("\t", "\n").split("\n") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, t):
    sets = [shingles(text, n) for _, text in rows]
    label = list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= t:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def varied(seed, bases, copies, length, edits):
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(bases):
        base = [dice.choice(words) for _ in range(dice.randint(*length))]
        for _ in range(copies):
            own = list(base)
            for _ in range(dice.randint(*edits)):
                k = dice.randrange(len(own) + 1)
                own[k : k + dice.randint(0, 1)] = [dice.choice(words)] if dice.random() < 0.5 else []
            rows.append(" ".join(own))
    dice.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n, t, length, edits", [(3, Fraction(9, 10), (1, 60), (0, 2)), (5, Fraction(4, 5), (1, 90), (0, 5)), (3, Fraction(9, 10), (100, 250), (0, 6)), (5, Fraction(4, 5), (60, 200), (0, 8))])
def test_join_against_brute_force(spark, n, t, length, edits):
    rows = varied(hash((n, length)) % 1000, 25, 12, length, edits) + [(5000, ""), (5001, "   "), (5002, "One"), (5003, "one"), (5004, "one two")]
    got = N.join(spark.createDataFrame([*rows, (6000, None)], DOCS), n, t).collect()
    wanted = brute(rows, n, t) | {6000: (0, 6000)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == wanted and len(got) == len(wanted)


def test_similar_sets_always_share_a_signature():
    dice = np.random.default_rng(7)
    for t in (Fraction(9, 10), Fraction(4, 5)):
        bands = N.Bands(t)
        for _ in range(1500):
            size = int(dice.integers(1, 160 if dice.random() < 0.7 else 700))
            a = dice.integers(0, 2**63, size).astype(np.uint64)
            b = a.copy()
            for _ in range(int(dice.integers(0, max(1, int(size * 0.25))))):
                b = np.delete(b, dice.integers(len(b))) if dice.random() < 0.5 and len(b) > 1 else np.append(b, np.uint64(dice.integers(0, 2**63)))
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if Fraction(common, len(a) + len(b) - common) < t:
                continue
            values, offsets = np.concatenate([a, b]), np.asarray([0, len(a), len(a) + len(b)])
            signed, slots, of = N.signatures(values, offsets, bands)
            both = [{(x, slot >> 32): slot & 0xFFFFFFFF for x, slot, o in zip(signed.tolist(), slots.tolist(), of.tolist(), strict=True) if o == i} for i in (0, 1)]
            shared = both[0].keys() & both[1].keys()
            # what is left where each leaves out as much as it may
            assert any(sum(b == band for _, b in shared) > max(both[0][x, band], both[1][x, band]) for x, band in shared), (t, len(a), len(b), common)
            (one, two), _ = N.sketches(values, offsets)
            differ = sum(int(x).bit_count() for x in np.bitwise_xor(one, two).view(np.uint64))
            assert differ <= len(a) + len(b) - 2 * common


def test_large_sketches_fold_and_never_rule_out_similar_sets(spark):
    from pyspark.sql import functions as F

    dice, t = np.random.default_rng(5), Fraction(4, 5)
    rows, exact = [], []
    for size, edits in ((1000, 90), (1040, 100), (2100, 200), (3000, 2500), (5000, 20), (700, 0), (1030, 8)):
        a = np.unique(dice.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[edits // 2 :], dice.integers(0, 2**63, edits // 2).astype(np.uint64)]))
        _, (x, y) = N.sketches(np.concatenate([a, b]), np.asarray([0, len(a), len(a) + len(b)]))
        rows.append((len(rows), {"n": len(a), "l": x.tolist()}, {"n": len(b), "l": y.tolist()}))
        common = len(np.intersect1d(a, b))
        exact.append(Fraction(common, len(a) + len(b) - common) >= t)
    df = spark.createDataFrame(rows, "id int, a struct<n: bigint, l: array<bigint>>, b struct<n: bigint, l: array<bigint>>")
    got = [r.ok for r in df.select("id", N.near_large(F.col("a"), F.col("b"), t).alias("ok")).orderBy("id").collect()]
    assert all(g or not e for g, e in zip(got, exact, strict=True)) and not got[3]


def test_a_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[i:] + [f"x{k}" for k in range(i)])) for i in range(40)]
    got = N.join(spark.createDataFrame(rows, DOCS), 3, Fraction(9, 10)).collect()
    assert {r.component_id for r in got} == {0} and len({r.class_id for r in got}) == 40


def test_edges(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A B C D"), (None, "a b c d"), (3, None), (4, "x y z")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in N.join(spark.createDataFrame(rows, DOCS), 3, Fraction(9, 10)).collect())
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (-1, 2, None), (3, 0, 3), (4, 1, 4)], key=lambda x: (x[0], x[1]))
    assert N.join(spark.createDataFrame([], DOCS), 3, Fraction(9, 10)).collect() == []


def test_components_of_random_links(spark):
    dice = random.Random(2)
    links = [(dice.randrange(300), dice.randrange(300)) for _ in range(170)]
    label = {i: i for i in range(300)}
    for _ in range(300):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in N.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(label[n] == c for n, c in got.items()) and {n for pair in links for n in pair if pair[0] != pair[1]} == set(got)


def test_words_are_those_of_the_contract():
    texts = ["Aé  b\tC\x0bd\x1fe", "", " x"]
    hashed, offsets = W.hashes([t.encode() for t in texts])
    assert np.diff(offsets).tolist() == [4, 0, 1]
    again, _ = W.hashes(["aé".encode(), b"b", b"c", b"d\x1fe"])
    assert hashed[:4].tolist() == again.tolist()
