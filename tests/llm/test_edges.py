"""Odd rows for every operator on documents: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import byte_bpe, fingerprints, language_id, line_dedup, lm_scoring, ngram_join, queries, source_mixing, toxicity

PATH = public_tokenizers.path(queries.BPE_FILE)
LONG = " ".join(f"w{i % 5000} and{i % 77}" for i in range(150_000)) + "\n" + "x" * 300_000 + "\n" * 2000 + "the end of it"
ROWS = [
    (1, "the cat sat on the mat, and the dog did not", "en", "web", 44), (1, "the cat sat on the mat, and the dog did not", "en", "web", 44), (2, None, "en", None, None),
    (3, "", None, "web", 0), (4, " \n\t ", "fr", "a", 3), (5, LONG, "en", "a", len(LONG)), (6, LONG, "en", "web", len(LONG)), (None, "le chat et le chien sur la table", "fr", "b", 32),
    (None, None, None, None, None), (8, "le chat et le chien sur la table, et le reste", "fr", "b", 45), (8, "same id, other text than the one before", "en", "b", 39), (9, "123 456", None, "b", 7),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators add, or use on the way.
CLASHING = ("line", "h", "n", "size", "taken", "times", "source_size", "target", "doc", "w", "fingerprint", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "log_likelihood", "mean_log_likelihood", "severity", "grade", "toxic_pred",
            "lang_pred", "score", "rejected", "n_lines", "n_removed", "component_id", "class_id", "n_shingles", "place", "level", "digest", "at", "part", "key")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def models(spark, frame):
    """Every operator as a function of documents that gives a row for each, by name."""
    words = lm_scoring.vocabulary(frame)
    net, table = lm_scoring.train(frame, words), lm_scoring.spelling(frame, words)
    known = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (8, 1), (None, 1)], "doc_id bigint, toxic int")
    return {
        "dedup": line_dedup.dedup_lines, "mix": source_mixing.mix, "fingerprint": fingerprints.fingerprint, "next": fingerprints.against_next,
        "lm": lambda d: lm_scoring.score(d, words, net, table=table), "join": lambda d: ngram_join.join(d, 3, Fraction(9, 10)), "lang": lambda d, m=language_id.learn(frame): language_id.identify(d, m),
        "bpe": lambda d: byte_bpe.digests(d, PATH, public_tokenizers.PATTERN, with_ids=True), "toxic": lambda d, m=toxicity.fit(*toxicity.sample(frame, known)): toxicity.score(d, m),
    }


def test_a_row_for_each_row_and_clashing_columns_change_nothing(spark, docs):
    wide = docs
    for name in CLASHING:
        wide = wide.withColumn(name, F.lit("own"))
    for name, run in models(spark, docs).items():
        plain, other = run(docs), run(wide)
        assert plain.count() == len(ROWS), name
        added = [c for c in plain.columns if c not in ("text", "lang", "source", "n_chars")]
        assert sorted(map(repr, plain.select(added).collect())) == sorted(map(repr, other.select(added).collect())), name
        carried = [c for c in CLASHING if c in other.columns and c not in plain.columns]
        assert other.filter(" OR ".join(f"`{c}` <> 'own'" for c in carried) or "false").count() == 0, name


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for name, run in models(spark, none).items():
        assert run(none).collect() == [], name
        assert run(docs).count() == len(ROWS), name  # models of nothing


def test_defined_results(spark, docs):
    run = models(spark, docs)
    cut = {(r.doc_id, r.n_chars): r for r in run["dedup"](docs).collect()}
    assert cut[2, None].text is None and cut[3, 0].text == "" and cut[5, len(LONG)].text == LONG and cut[6, len(LONG)].n_removed == cut[6, len(LONG)].n_lines == 3
    assert "the end" not in cut[6, len(LONG)].text and cut[1, 44].n_removed == 0
    sizes = {r.doc_id: r.size for r in run["mix"](docs).collect()}
    assert sizes[2] == sizes[3] == sizes[4] == 0 and sizes[5] == len(LONG.split())
    for r in run["mix"](docs).collect():
        assert 0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size
    prints = {r.doc_id: r.fingerprint for r in run["next"](docs).collect()}
    assert prints[5] == prints[6] and prints[2] == prints[3] == prints[4] == "" and prints[1]
    scored = {r.doc_id: r for r in run["lm"](docs).collect()}
    assert scored[2].log_likelihood == 0 and scored[2].mean_log_likelihood is None and scored[5].log_likelihood == pytest.approx(scored[6].log_likelihood) and scored[5].n_tokens == len(LONG.split())
    joined = run["join"](docs).collect()
    assert {r.doc_id: r.component_id for r in joined if r.doc_id in (1, 2, 3, 5, 6, 9)} == {1: 1, 2: 2, 3: 3, 5: 5, 6: 5, 9: 9} and all(r.component_id is None for r in joined if r.doc_id is None)
    tongues = {r.doc_id: r for r in run["lang"](docs).collect()}
    assert all(tongues[i].lang_pred == "und" and tongues[i].rejected for i in (2, 3, 4, 9)) and tongues[5].lang_pred == "en"
    coded = {r.doc_id: r for r in run["bpe"](docs).collect()}
    assert coded[2].n_tokens == 0 and coded[2].ids == [] and coded[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() == coded[6].decoded_sha256
    grades = {r.doc_id: r.severity for r in run["toxic"](docs).collect()}
    assert grades[2] == grades[3] and grades[5] == grades[6] and all(0 <= x <= toxicity.GRADES - 1 for x in grades.values())


def test_stages_of_the_pipeline_keep_their_columns_and_clean_rows(spark, docs):
    """Each stage on odd rows: what it must drop goes, what it must keep stays, and extra rows never appear but by mixing."""
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/nowhere")
        rows = out.collect()
        kept[name] = [r.doc_id for r in rows]
        if name != "byte_bpe":
            assert out.columns == docs.columns, name
            whole = {(r[0], r[1]) for r in ROWS}
            assert name == "line_dedup" or all((r.doc_id, r.text) in whole for r in rows), name
            assert all(r.n_chars is None or r.text is None or r.n_chars == len(r.text) or r.n_chars == dict((a, e) for a, _, _, _, e in ROWS)[r.doc_id] for r in rows)
        assert stage(spark, docs.limit(0), "/nowhere").collect() == [], name
    assert not {2, 3, 4, 9} & set(kept["language_id"]) and {5, 6, 8} <= set(kept["language_id"])
    assert 5 in kept["line_dedup"] and 6 not in kept["line_dedup"] and {1, 2, 3, 8} <= set(kept["line_dedup"])
    assert kept["ngram_join"].count(1) == 1 and kept["ngram_join"].count(5) == 1 and 6 not in kept["ngram_join"] and kept["ngram_join"].count(None) == 2
    assert max(kept["source_mixing"].count(i) for i in (5, 6, 8)) <= 4 and len(kept["byte_bpe"]) == len(ROWS)


def test_a_run_of_the_pipeline_leaves_one_table(spark, tmp_path):
    from corvane.llm.common import clear_stored, made

    dice = random.Random(3)
    pool = {"en": "the of and with cat dog house river".split(), "fr": "le la et avec chat chien maison eau".split()}
    rows = [(i, " ".join(dice.choice(pool[k]) for _ in range(60)), k, k, 300) for i, k in enumerate(["en", "fr"] * 30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    before = made()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert made() == before + 1 and out.count() > 20 and clear_stored(spark, before) == 1


def test_a_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from corvane import session

    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster)
    assert session.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "viewfs://x/y/"))) == "viewfs://x/y"


def test_hash_table_finds_all_keys():
    from corvane.llm.words import Table

    dice = np.random.default_rng(2)
    keys = np.unique(np.concatenate([dice.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2), np.arange(50, dtype=np.uint64), np.asarray([2**64 - 1], np.uint64)]))
    table = Table(keys, np.arange(len(keys)))
    assert (table.get(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(dice.integers(0, 2**63, 3000).astype(np.uint64), keys)
    assert (table.get(others) == -1).all() and len(Table(keys[:0], np.zeros(0)).get(keys)) == len(keys)
