"""Mixing, line dedup, MaxScore and chat formatting against brute force, with their edge cases."""

import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import chat_format as cf
from quire.llm import line_dedup as ld
from quire.llm import maxscore as ms
from quire.llm import mixing as mx

# Mixing


def mixed(spark, rows):
    frame = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, taken long")
    return mx.mix_sources(frame).collect()


def test_mixing_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 30))), r.choice(["a", "a", "a", "a", "b", "Z", None])) for i in range(400)] + [(900, None, "empty"), (901, "", "empty")]
    found = mixed(spark, rows)
    total = sum(x.size for x in found)
    per = {s: (sum(x.taken for x in found if x.source == s), next(x.target for x in found if x.source == s), next(x.source_size for x in found if x.source == s)) for s in {x.source for x in found}}
    assert all(taken == round(target) and target <= 3 * size for taken, target, size in per.values())
    assert abs(sum(t for _, t, _ in per.values()) - total) < 1e-6
    assert all(x.taken <= 3 * x.size for x in found)
    # weights by code point: Z 1, a 2, b 3, empty 1, null 2
    level = {s: t / w for s, w in (("Z", 1), ("a", 2), ("b", 3), (None, 2)) if (t := per[s][1]) < 3 * per[s][2]}
    assert max(level.values()) - min(level.values()) < 1e-6
    assert sorted(map(tuple, mixed(spark, rows)), key=repr) == sorted(map(tuple, found), key=repr)


def test_mixing_edges(spark):
    assert mixed(spark, []) == []
    assert [(x.size, x.taken) for x in mixed(spark, [(1, None, None), (None, "", "a")])] == [(0, 0), (0, 0)]
    assert sorted((x.size, x.taken) for x in mixed(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a", "s")])) == [(1, 1), (3, 3), (3, 3)]
    docs = spark.createDataFrame([(1, "a b", "s", "x"), (2, "c d e f", "t", "y"), (3, None, "t", "z")], "doc_id long, text string, source string, size string")
    assert mx.mixed_documents(docs).columns == docs.columns


# Line dedup


def lines_by_hand(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(" \t\n\x0b\x0c\r")
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return sorted((i or -1, len(x := (t or "").split("\n")), sum(held[key(y)] >= least for y in x), "\n".join(y for y in x if held[key(y)] < least)) for i, t in rows)


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 3), (4, 3), (9, 2)])
def test_lines(spark, monkeypatch, batches, fan_in):
    monkeypatch.setattr(ld.LineRuns.__init__, "__defaults__", (fan_in,))
    r = random.Random(7)
    pool = ["Shared line", "  shared LINE\t", "other", "ÉTÉ", "été", "x", "", " ", "rare"] + [f"line {i}" for i in range(60)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(150)] + [(None, "Shared line\nown"), (500, None), (501, ""), (502, "\n"), (503, "long " * 40_000 + "\nshared line")]
    frame = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_lines int")
    got = ld.drop_repeated_lines(frame, batches=batches).collect()
    assert sorted((x.doc_id or -1, x.n_lines, x.n_dropped, x.kept_text) for x in got) == lines_by_hand(rows)


def test_lines_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert ld.drop_repeated_lines(frame).count() == 0


def test_runs_tell_new_lines(spark):
    runs = ld.LineRuns(spark, 2)
    batch = lambda *x: spark.createDataFrame([(i, 0) for i in x], "a long, b int")
    seen = set()
    for lines in ([1, 2, 2], [2, 3], [4], [1, 5], [6]):
        assert {x.a for x in runs.unseen(batch(*lines)).collect()} == set(lines) - seen
        runs.add(batch(*lines))
        seen |= set(lines)
    assert {x.a: x.docs for x in runs.merged().collect()} == {1: 2, 2: 3, 3: 1, 4: 1, 5: 1, 6: 1}
    assert len(runs.runs) <= 3 and all(len(level) < 2 for level in runs.levels)


# MaxScore


def best_by_hand(rows, queries, k=10):
    out = []
    for q, v in queries:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [ms.SHARD_ROWS, 40])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(ms, "SHARD_ROWS", shard)
    r = random.Random(1)
    rows = [(i, [r.randint(-20, 20) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 330)] + [(400, None), (None, [1] * 8), (401, [1, 2]), (402, [3, 4]), (403, [])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    clean = [(i, v) for i, v in rows if i is not None and v is not None]
    asked = [x for x in clean if x[0] % 10 == 0 or x[0] in (401, 403)]
    got = ms.top_k(frame, frame.where("vec_id % 10 = 0 or vec_id in (401, 403)"))
    assert sorted(map(tuple, got.collect())) == best_by_hand(clean, asked)


def test_top_k_skips_postings():
    rng = np.random.default_rng(3)
    q = np.array([400, 200, 100, 40, 10, 5, 2, 1])
    shard = rng.integers(-50, 50, (8, 20_000))
    ids = np.arange(20_000)
    found, score, read = ms.top_rows(q, -1, ids, shard, shard.min(axis=1), shard.max(axis=1), 10)
    every = q @ shard
    want = np.lexsort((ids, -every))[:10]
    assert found.tolist() == want.tolist() and score.tolist() == every[want].tolist()
    assert read < 0.7 * shard.size


def test_top_k_edges(spark):
    rows = [(0, [1.0, float("nan")]), (1, [1.0, None]), (2, None), (3, [float("inf"), 1.0]), (4, [0.5, 0.25]), (5, [1e300, -1e300])]
    frame = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", ms.quantized("e").alias("v"))
    assert [x.vec_id for x in frame.where("v is not null and vec_id < 5").collect()] == [4]
    big = spark.createDataFrame([(i, [(1 << 40) + i, -3]) for i in range(5)], "vec_id long, v array<long>")
    got = ms.top_k(big, big.where("vec_id = 0")).collect()
    assert [x.vec_id for x in sorted(got, key=lambda x: x.rank)] == [1, 2, 3, 4] and all(x.score == (1 << 63) - 1 for x in got)
    assert ms.top_k(big.limit(0), big.limit(0)).count() == 0


# Chat formatting


def shown(turns):
    return "".join(f"<|turn|>{a or ''}\n{b or ''}<|end|>\n" for a, b in turns)


def test_preferences(spark):
    u, a = ("user", "hi"), ("assistant", "yo")
    cases = [([u, a, u, ("assistant", "good")], [u, a, u, ("assistant", "bad")]), ([u, a], [u, a, u]), ([u], [a]), (None, [a]), ([], []), ([(None, None), a], [(None, None), u]), ([("user", "é" * 50_000)], [])]
    kind = "array<struct<role:string,text:string>>"
    frame = spark.createDataFrame([(i, c, r, "keep") for i, (c, r) in enumerate(cases)], f"pair int, chosen {kind}, rejected {kind}, prompt string")
    got = {x.pair: x for x in cf.format_preferences(frame).collect()}
    for i, (c, r) in enumerate(cases):
        c, r = c or [], r or []
        n = next((k for k, (x, y) in enumerate(zip(c, r, strict=False)) if x != y), min(len(c), len(r)))
        x = got[i]
        assert (x.prompt, x.prompt_turns, x.chosen_text, x.rejected_text) == (shown(c[:n]), n, shown(c[n:]), shown(r[n:]))
        for text, mask, turns in ((x.chosen_text, x.chosen_mask, c[n:]), (x.rejected_text, x.rejected_mask, r[n:])):
            assert [text[s.start : s.stop] for s in mask] == [f"{t}<|end|>\n" for role, t in turns if role == "assistant"]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (None, 0, "user", "x"), (None, 0, "user", "x"), (2, 0, "user", "q"), (3, None, None, None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = cf.stale_reply_pairs(cf.conversations_of(frame)).collect()
    assert sorted((x.conv_id or -1, len(x.chosen), len(x.rejected)) for x in got) == [(-1, 1, 1), (-1, 1, 1), (1, 2, 2), (2, 1, 1), (3, 1, 1)]
    assert [x.rejected[-1].text for x in got if x.conv_id == 1] == [""]
    assert cf.format_preferences(cf.stale_reply_pairs(cf.conversations_of(frame.limit(0)))).count() == 0




def test_stage_keeps_columns(spark):
    rows = [(i, "Shared\nown %d" % i, 77, "mine", 5) for i in range(12)] + [(99, None, 78, "m", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, kept_text string, n_chars long")
    found = ld.documents_without_repeats(frame)
    assert found.columns == frame.columns
    assert sorted(map(tuple, found.collect())) == sorted([(i, "own %d" % i, 77, "mine", len("own %d" % i)) for i in range(12)] + [(99, None, 78, "m", 6)], key=lambda r: r[0])
    assert ld.documents_without_repeats(frame.drop("n_chars")).count() == 13 and ld.documents_without_repeats(frame.limit(0)).count() == 0


# Written tables


def test_written_tables(spark):
    from quire.llm import common

    frame = spark.range(10).selectExpr("id", "cast(id % 3 as int) as k")
    table = common.written(frame, "t", partition_by="k")
    assert sorted(table.columns) == ["id", "k"] and table.count() == 10
    common.dropped(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/quire")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    common.written(frame, "u")
    assert fs.exists(path)
    common.clear(spark)
    assert not fs.exists(path)
