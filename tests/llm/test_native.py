"""Line dedup and source mixing."""

import duckdb
import pytest

from corvane.llm import line_dedup, queries, source_mixing
from corvane.llm.common import stored

DOCS = "doc_id bigint, text string"


def brute(rows, least):
    """Lines kept of each (id, text), by comparing all places with all earlier ones."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    full = [[(i, line.strip(" \t\n\x0b\x0c\r")) for i, line in enumerate(t.split("\n")) if line.strip(" \t\n\x0b\x0c\r")] for _, t in docs]
    gone = {d: set() for d in range(len(docs))}
    for b in range(len(docs)):
        for a in range(b + 1):
            for shift in range(-len(full[a]), len(full[b]) + 1):
                run = []
                for j in range(len(full[b]) + 1):
                    i = j - shift
                    same = j < len(full[b]) and 0 <= i < len(full[a]) and full[a][i][1] == full[b][j][1] and (a < b or i < j)
                    if same:
                        run.append(j)
                        continue
                    if run and sum(len(full[b][k][1].split()) for k in run) >= least:
                        gone[b] |= set(range(full[b][run[0]][0], full[b][run[-1]][0] + 1))
                    run = []
    return {docs[d]: "\n".join(x for i, x in enumerate(docs[d][1].split("\n")) if i not in gone[d]) for d in range(len(docs))}


def same_order(rows):
    return sorted(rows, key=repr)


def test_line_dedup_against_brute_force(spark):
    import random

    dice = random.Random(3)
    pool = ["one two three", "four", "five six", "", "seven eight nine ten", "  four ", "eleven twelve"]
    rows = [(i, "\n".join(dice.choice(pool) for _ in range(dice.randint(0, 14)))) for i in range(40)]
    rows += [(41, None), (42, ""), (43, "\n\n"), rows[3], (None, rows[5][1])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), least_words=8).collect()
    kept = brute(rows, 8)
    assert len(got) == len(rows)
    wanted = same_order((i, kept.get((i, t), t)) for i, t in rows)
    assert same_order((r.doc_id, r.text) for r in got) == wanted
    assert any(r.n_removed for r in got) and all(r.n_removed <= r.n_lines for r in got)


def test_line_dedup_leaves_clean_texts_and_extra_columns(spark):
    text = "short line\r\n\n  kept as it is  "
    df = spark.createDataFrame([(1, text, 7, "x"), (2, "other", 8, "y")], "doc_id bigint, text string, n_lines int, window string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1].text == text and got[1].n_removed == 0 and got[1].n_lines == 2 and got[2]["window"] == "y"
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_a_passage_of_fifty_words_goes_from_all_but_its_first_place(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [(i, f"head {i}\n{passage}\ntail {i}") for i in range(30)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"head {i}\ntail {i}" for i in range(1, 30))


def test_matches_come_from_fingerprints_and_are_compared_line_by_line(spark):
    import random

    from pyspark.sql import functions as F

    dice = random.Random(5)
    pool = [" ".join(f"w{i}x{k}" for k in range(dice.randint(1, 4))) for i in range(30)]
    base = [dice.choice(pool) for _ in range(60)]
    rows = [(i, "\n".join(base[i * 3 : i * 3 + 25] + [f"own line {i}"])) for i in range(10)]
    each = line_dedup.lines(spark.createDataFrame(rows, DOCS))
    places = stored(line_dedup.fingerprints(each, 8))
    assert 0 < places.count() < each.count()
    assert line_dedup.matches(places, 8).count() and not line_dedup.matches(places.limit(0), 8).count()
    # without the fingerprints of the first places nothing is found there
    assert not line_dedup.matches(stored(places.filter("place.doc_id = 3")), 8).filter("doc_id <> 3").count()
    # equal digests of lines that differ, as hashes may have: the lines decide
    own = F.col("place.doc_id")
    changed = stored(places.withColumns({"k": own, "back": F.transform("back", lambda x: x.withField("k", own)), "ahead": F.transform("ahead", lambda x: x.withField("k", own))}))
    found = {(r.doc_id, r.start, r.stop) for r in line_dedup.matches(changed, 8).collect()}
    assert found < {(r.doc_id, r.start, r.stop) for r in line_dedup.matches(places, 8).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_of_long_texts_against_brute_force(spark, seed):
    import random

    dice = random.Random(seed)
    pool = [" ".join(f"w{dice.randrange(40)}" for _ in range(dice.choice([1, 2, 3, 9]))) for _ in range(6 + 10 * seed)]
    rows = [(i, "\n".join(dice.choice(pool) for _ in range(dice.choice([3, 30, 90])))) for i in range(12)]
    rows += [(90 + i, " ".join(f"v{k}" for k in range(3000)) + f"\n{i}") for i in range(3)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), least_words=12).collect()}
    assert got == {k[0]: v for k, v in brute(rows, 12).items()}


def mixed_by_hand(rows, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target = share * sum(sizes.values()), {}
    left = dict(sizes)
    while left:
        level = budget / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] > most * sizes[s]]
        if not over:
            target |= {s: level * w[s] for s in left}
            break
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
            del left[s]
    return sizes, target


def corpus(n=400):
    import random

    dice = random.Random(5)
    names = ["b", "a", "é", None, "c", "Z"]
    return [(i, " ".join("w" for _ in range(dice.randint(0, 40))), names[min(5, int(dice.random() ** 2 * 6))]) for i in range(n)]


def test_mixing_meets_its_targets(spark):
    rows = corpus() + [(1000, None, "b"), (1001, "", None), (7, "again and again", "a"), (7, "again and again", "a")]
    got = source_mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sizes, target = mixed_by_hand(rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size and r.taken == r.times * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - target[source]) <= 41


def test_mixing_reruns_agree_and_copies_rows(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, source string")
    one = sorted((r.doc_id, r.taken) for r in source_mixing.mix(df).collect())
    assert one == sorted((r.doc_id, r.taken) for r in source_mixing.mix(df.repartition(5)).collect())
    clash = df.selectExpr("doc_id", "text", "source", "'mine' AS size")
    out = source_mixing.mixed(clash).collect()
    assert sum(len(r.text.split()) for r in out) == sum(t for _, t in one) and {r["size"] for r in out} == {"mine"}
    assert source_mixing.mix(df.limit(0)).collect() == [] and source_mixing.mixed(df.limit(0)).collect() == []


def test_quality_counts(spark):
    rows = [(i, "w " * 10, "a") for i in range(1000)] + [(2000 + i, "w " * 10, "b") for i in range(3000)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = source_mixing.mix(df, quality=F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)).filter("source = 'b' AND times > 1").collect()
    assert got == [] or sum(r.doc_id % 2 == 0 for r in got) > len(got) / 2
    some = source_mixing.mix(df, weights=(1.0, 1.0), share=0.5, quality=F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)).filter("source = 'b' AND times = 1").collect()
    assert sum(r.doc_id % 2 == 0 for r in some) > 0.7 * len(some) > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for t in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.queries()[name](spark, folder)
    found = connection.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == sorted(repr(list(r)) for r in found.fetchall())


def test_stored_keeps_schema(spark):
    df = spark.range(5).selectExpr("id", "array(id) AS v")
    assert stored(df).dtypes == df.dtypes and stored(df.limit(0)).count() == 0


def test_stored_tables_can_be_cleared(spark):
    from corvane.llm.common import clear_stored

    clear_stored(spark)
    df = stored(spark.range(3))
    path = df.inputFiles()[0]
    assert clear_stored(spark) == 1
    import os

    assert not os.path.exists(path.removeprefix("file://"))
