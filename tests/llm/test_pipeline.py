"""Each stage against a brute-force version on its own input."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quire.llm import sentencepiece_codec as codec  # noqa: E402
from quire.llm import toxicity  # noqa: E402
from tests.llm.test_near_dup import brute as near_brute  # noqa: E402

SPACE = " \t\n\x0b\x0c\r"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """(name, input rows, output) of each stage, each output written and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns(stages, spark, sf):
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "source_mixing", "sentencepiece"]
    assert all(stages[n][1].columns == names for n in list(stages)[:-1])


def test_toxicity(stages, spark, sf):
    before, after = stages["toxicity"]
    machine = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    want = [tuple(r) for r in before.collect() if machine.scores([(r.text or "").encode()])[0] < toxicity.THRESHOLD]
    assert rows(after) == sorted(want, key=repr)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(SPACE)
    docs = before.collect()
    held = Counter(k for r in docs for k in {key(x) for x in (r.text or "").split("\n")} if k)
    want = []
    for r in docs:
        text = "\n".join(x for x in r.text.split("\n") if held[key(x)] < 10)
        want.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert rows(after) == sorted(want, key=repr)


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    docs = before.collect()
    marks = near_brute([(r.doc_id, r.text) for r in docs], 80)
    assert rows(after) == sorted([tuple(r) for r in docs if marks[r.doc_id][2]], key=repr)


def test_mixing(stages):
    before, after = stages["source_mixing"]
    docs = before.collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    of = defaultdict(list)
    for r in docs:
        of[r.source].append(r)
    names = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = {s: sum(size[r.doc_id] for r in of[s]) for s in names}
    target, free = dict.fromkeys(names, 0.0), set(names)
    excess = float(sum(total.values()))
    while excess > 1e-6 and free:
        share = excess / sum(weight[s] for s in free)
        excess = 0.0
        for s in sorted(free, key=str):
            target[s] += share * weight[s]
            if target[s] > 3 * total[s]:
                excess += target[s] - 3 * total[s]
                target[s] = 3.0 * total[s]
        free = {s for s in free if target[s] < 3 * total[s]}
    want = Counter()
    for s in names:
        budget, done = round(target[s]), 0
        epochs = budget // total[s] if total[s] else 0
        for r in sorted(of[s], key=lambda r: (hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest(), size[r.doc_id])):
            n = size[r.doc_id]
            part = max(0, min(n, budget - epochs * total[s] - done))
            done += n
            want[r.doc_id] = epochs + (2 * part >= n) if n else 1
    found = Counter(r.doc_id for r in after.collect())
    assert found == +want
    texts = {r.doc_id: r.text for r in docs}
    assert all(r.text == texts[r.doc_id] for r in after.collect())


def test_sentencepiece(stages):
    before, after = stages["sentencepiece"]
    pieces = codec.load()
    texts = {r.doc_id: r.text for r in before.collect()}
    found = after.collect()
    assert len(found) == before.count()
    for r in found:
        assert r.round_trip and codec.decode(pieces, np.array(r.pieces, dtype=np.int64), np.array([len(r.pieces)])) == [texts[r.doc_id].encode()]


def test_run(stages, spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert rows(out) == rows(stages["sentencepiece"][1])
