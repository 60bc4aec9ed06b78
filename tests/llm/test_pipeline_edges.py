"""The stages on rows that are null, empty, repeated or very long, with extra columns of names that the operators use inside."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _d string, row string, score double, taken string, kept_text string"
EXTRA = ("d", "r", 0.5, "t", "k")
LONG = "word " * 80_000
ROWS = [
    (1, "one two three four five six", "en", "a", 27, *EXTRA),
    (1, "one two three four five six", "en", "a", 27, *EXTRA),
    (2, "one two three four five six", None, "b", 27, *EXTRA),
    (3, None, "en", "a", None, *EXTRA),
    (4, "", "en", None, 0, *EXTRA),
    (None, "lone words of a row without an id", None, None, 33, *EXTRA),
    (5, LONG, "en", "b", len(LONG), *EXTRA),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(2, 0), (3, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def results(spark, tables, rows):
    docs, out = spark.createDataFrame(rows, COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, tables)
        if name != "sentencepiece":
            assert found.columns == docs.columns
        out[name] = sorted(map(tuple, found.collect()), key=repr)
    return out


def test_edges(spark, tables):
    out = results(spark, tables, ROWS)
    every = sorted(ROWS, key=repr)
    assert out["toxicity"] == every  # labels of one class teach nothing
    assert out["line_dedup"] == every  # no line is in ten rows
    assert out["near_dedup"] == [r for r in every if r[0] != 2]  # the rows of id 1 are one document
    assert {r[0] for r in out["source_mixing"]} <= {r[0] for r in ROWS} and all(r in ROWS for r in out["source_mixing"])
    assert {3, 4} <= {r[0] for r in out["source_mixing"]}  # without words they cost nothing
    assert len(out["sentencepiece"]) == len(ROWS)


def test_empty_tables(spark, tables):
    assert all(found == [] for found in results(spark, tables, []).values())
