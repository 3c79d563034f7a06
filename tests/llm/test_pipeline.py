"""Each stage of the pipeline against a plain version, on what the stage before kept."""

import collections

import numpy as np
import pyarrow as pa
import pytest
import tiktoken  # noqa: F401  the library that ``library`` compares with

import corpus_pipeline
from plumbline.llm import quality
from plumbline.llm import textbatch as tb
from plumbline.llm.shared import stored
from tests.llm.test_operators import draw, jaccard_classes, library, surviving  # noqa: F401

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], DATA), "test_stage"))
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns(stages):
    assert all(s.columns == COLUMNS for s in stages[:5])


def test_quality(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before, after = dict(rows(stages[0])), dict(rows(stages[1]))
    assert set(after.items()) <= set(before.items()) and len(after) < len(before)
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in after for i in good) / len(good) > 0.97
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in after for i in bad) / len(bad) < 0.5


def test_quality_scores_follow_the_weights(spark, stages):
    weights = np.random.default_rng(0).normal(size=(1 << quality.Settings().bits) + 1).astype(np.float32)
    got = {r.doc_id: r.s for r in stages[0].select("doc_id", quality.score_of(stages[0], weights).alias("s")).collect()}
    for i, text in rows(stages[0])[:40]:
        slots, values, _ = quality.features(*tb.text_bytes(pa.array([text])), quality.Settings().bits)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(values @ weights[slots] + weights[-1]))))


def test_lines(stages):
    before = rows(stages[1])
    want = [(i, t) for (i, old), t in zip(before, surviving(before), strict=True) if t == old or t.strip(" \t\n\v\f\r")]
    assert rows(stages[2]) == want and want != before


def test_documents(stages):
    before = rows(stages[2])
    _, roots = jaccard_classes([t for _, t in before])
    least = {}
    for (i, _), r in zip(before, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    assert rows(stages[3]) == [(i, t) for (i, t), r in zip(before, roots, strict=True) if least[r] == i]


def test_mixing(stages):
    before = [(r.doc_id, r.source, r.text) for r in stages[3].collect()]
    counts = collections.Counter(s for _, s, _ in before)
    rate = {s: len(before) / len(counts) / n for s, n in counts.items()}
    want = {i: n for i, s, t in before if (n := draw(rate[s], i, t))}
    assert collections.Counter(r.doc_id for r in stages[4].collect()) == want


def test_encoding(stages, library):  # noqa: F811
    texts = dict(rows(stages[4]))
    got = stages[5].collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in stages[4].collect())
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)


def test_run_chains_the_stages(spark, stages):
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == sorted((r.doc_id, r.ids_sha256) for r in stages[5].collect())


def tables(spark, folder, rows, labels):
    """A table of documents with odd rows, and of labels."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy int, id long, text_hash long, score double, label int, row string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_documents(spark, tmp_path, library):  # noqa: F811
    """Nulls, empty and very long texts, repeated rows, equal ids and clashing names go through all stages."""
    extra = [None] * 6
    rows = [
        (1, "One two three four five six seven eight nine ten.", "en", "a", 5, *extra), (1, "One two three four five six seven eight nine ten.", "en", "a", 5, *extra),
        (1, "Another text under the same id, of some eight words or more.", "en", None, 5, *extra), (2, None, "en", "a", None, *extra), (3, "", None, None, 0, *extra), (4, " \n\t ", "de", None, 4, *extra),
        (None, "A row without any id, of some eight words or more.", "en", "b", 1, *extra), (None, "A row without any id, of some eight words or more.", "en", "b", 1, *extra), (None, None, None, None, None, *extra),
        (5, " ".join(f"word{k} \u00e9\u6f22" + "\n" * (k % 50 == 0) for k in range(20_000)), "en", "b", 1, *extra), (6, "x" * 70_000, None, "c", 1, *extra), (7, "12 34 !!! ??", "fr", "c", 1, *extra),
    ]
    folder = tables(spark, tmp_path, rows, [(1, 1, 0), (5, 1, 0), (7, None, None), (None, 1, 0)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, folder), "odd_stage")
        assert after.columns == docs.columns and after.count() <= 4 * len(rows)
        before = after
    kept = {r.text for r in before.collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, len(library.encode_ordinary(r.text or ""))) for r in before.collect())
    assert all(r.ids == [] for r in got if r.n_tokens == 0) and any(len(t or "") > 60_000 for t in kept | {"x" * 70_000})


def test_empty_documents(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert all(stage(spark, docs, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)
