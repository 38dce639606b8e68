"""The pipeline against its stages by brute force, on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from termweave.llm import bpe, decontaminate, near_dedup, secrets, toxicity, vocabularies


def corpus():
    r = random.Random(6)
    text = lambda seed, n: " ".join(f"w{random.Random(seed).randrange(10**6)}x{k}" for k in range(n))
    rows = [(i, text(i, 30 + i % 20)) for i in range(300)]
    rows = [(i, t + " grumblesnark") if i % 6 == 0 else (i, t) for i, t in rows]
    rows += [(1000 + i, rows[i][1]) for i in range(1, 300, 25)]
    rows += [(2000 + i, rows[i][1] + " tail") for i in range(2, 300, 25)]
    rows += [(3000 + i, rows[i][1] + " before alpha beta gamma delta epsilon zeta eta theta iota kappa after") for i in range(1, 20, 6)]
    rows += [(4000, "new words and token = 'abcdef123456' here"), (4001, None), (4002, "")]
    r.shuffle(rows)
    return rows


def test_run_matches_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, "Alpha beta gamma, delta epsilon zeta eta theta iota kappa"), (2, "unseen words of another item that no document has at all")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    left = [(i, t) for i, t in rows if scorer.score(t) < 0.5]
    assert {i for i, _ in left} == {i for i, t in rows if "grumblesnark" not in (t or "")}
    kept = {i for i, _, _, k in near_dedup.brute_force(left, corpus_pipeline.SHINGLE) if k}
    left = [(i, t) for i, t in left if i in kept]
    hit = {x[0] for x in decontaminate.brute_force(left, items) if x[-1]}
    assert hit == {i for i, t in left if "alpha" in (t or "")}
    left = [(i, t) for i, t in left if i not in hit]
    assert set(out) == {i for i, _ in left} and len(left) > 200
    codec = bpe.Codec(vocabularies.default_path(bpe.VOCABULARY), None)
    for i, t in left:
        spans = secrets.brute_force(t)
        if spans:
            assert out[i].text == "new words and [secret]' here"
        else:
            assert out[i].text == t
        assert out[i].ids == codec.encode(out[i].text) and out[i].n_tokens == len(out[i].ids)
        assert out[i].n_chars == len(out[i].text or "")


CLASHING = "_doc _text _row row score predicted contaminated hits _in _spans _base id text_ key part _prints bucket set_key".split()
NAMED = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark that leave the awkward documents alone."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "unseen words of an item that no document has at all"), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *CLASHING) for i, t in rows], NAMED)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_by_themselves(spark, folder, name, stage):
    """Nulls, empty and long texts, repeated rows and clashing names: what stays, and that it stays as it was."""
    long = " ".join(f"long{k}" for k in range(30_000))
    rows = [(None, "a null id"), (10, None), (11, ""), (12, " \n"), (13, "one"), (14, long), (15, "repeated row of words"), (15, "repeated row of words"), (16, None), (None, "another null id")]
    out = stage(spark, table(spark, rows), folder)
    assert out.columns[: len(CLASHING) + 5] == table(spark, []).columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    expected = rows[:7] + rows[8:] if name == "near_duplicates" else rows
    assert kept == sorted(expected, key=str)
    assert all([r[c] for c in CLASHING] == CLASHING and r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_nothing(spark, folder, name, stage):
    assert stage(spark, table(spark, []), folder).count() == 0


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5, "z")], "doc_id bigint, text string, lang string, source string, n_chars bigint, _doc string")
    for _, stage in corpus_pipeline.STAGES[1:4:2]:
        assert stage(spark, docs, "").columns == docs.columns
