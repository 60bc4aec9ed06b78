"""Removal of repeated byte strings with suffix arrays and longest previous factors.

One suffix array over a corpus fits no machine, so suffixes are sorted in groups that hold all that can match. In every
text, each string of ``LEAST`` bytes names one of its grams (of GRAM bytes), the one with the smallest hash: its anchor.
Equal strings name equal anchors at equal places, so only suffixes that start shortly before two occurrences of one
anchor can share ``LEAST`` bytes. Anchors that occur once end the matter after one count. Of the others, those whose
whole surroundings are equal match as a whole; one of each surroundings goes, with its bytes, to the group of its
anchor. There the suffix array of all starts is built backwards, a byte at a time, from the order of the suffixes one
byte on, together with the LCP array. A group too large for a task is split by more of what its strings must share.

In suffix order a suffix has an earlier match of LEAST bytes just if the previous or next smaller position is reached
over LCPs of LEAST or more (its longest previous factor is that long). That keeps first copies and removes later ones.
The mirrored factors, by previous and next larger positions, tell matches further on; both together remove the first
copies as well.

A text is known by 128 bits of its hash, never by its id, so ids may be null or repeated. Rows with one text are read
once; that they are copies of each other is a count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, POWER, POWER_INVERSE, dropped, mixed, powers, small_batches, written
from .near_dup import texts_of

LEAST, GRAM = 200, 80
#: Starts of a string before its anchor, and windows of grams that have one anchor.
LEFT = LEAST - GRAM
#: A long text is hashed in stretches of so many bytes, and so many more at both ends.
STRETCH, MARGIN = 256 << 10, 2 * LEAST
#: Surroundings that are sorted together, and those of one group beyond which it is split.
BLOCK, HOT = 60_000, 200_000
#: Rows of a batch of surroundings, and what stands for a null id in the order of rows.
ROWS, NO_ID = 4000, (1 << 63) - 1
PAD = 0xFF


def lpf(sa: list[int], lcp: list[int]) -> list[int]:
    """Longest previous factors by previous and next smaller positions in suffix order; lcp[i] is of sa[i - 1] and sa[i].

    The plain linear form; groups use its thresholded form over arrays (:func:`has_earlier`).
    """
    n = len(sa)
    out = [0] * n
    for order in (range(n), range(n - 1, -1, -1)):
        stack: list[tuple[int, int]] = []  # positions of suffixes seen, ascending, with the LCP to the one below
        for i in order:
            low = lcp[i] if order.step > 0 else (lcp[i + 1] if i + 1 < n else 0)
            while stack and stack[-1][0] > sa[i]:
                low = min(low, stack.pop()[1])
            if stack:
                out[sa[i]] = max(out[sa[i]], low)
            stack.append((sa[i], low))
    return out


def has_earlier(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Whether the longest previous factor of each suffix reaches ``least``: for suffixes in suffix order, with their positions.

    A run of LCPs of ``least`` or more is what smaller positions may be reached over, so the previous smaller position is
    in reach if the run's minimum so far is smaller, and the next smaller one likewise from the other end.
    """
    run = np.cumsum(lcp < least)
    span = int(order.max(initial=0)) + 1
    ahead, behind = order - run * span, (order + run * span)[::-1]  # each run lies below all that were met before it
    out = np.zeros(len(order), bool)
    out[1:] = np.minimum.accumulate(ahead)[:-1] < ahead[1:]
    back = np.zeros(len(order), bool)
    back[1:] = np.minimum.accumulate(behind)[:-1] < behind[1:]
    return out | back[::-1]


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    size = 1
    m = h
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - size : w - size + len(h) - w + 1])


def hash_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(POWER, len(data)), out=sums[1:])
    return sums, powers(POWER_INVERSE, len(data) + 1)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text's anchors, hashes of their grams, and hashes of their surroundings (LEFT bytes before to LEAST after, as far as the text goes).

    A long text is read in stretches with all the bytes around them that decide on their anchors.
    """
    n = len(data)
    if n <= STRETCH + 2 * MARGIN:
        return _anchors_of(data)
    parts = []
    for at in range(0, n, STRETCH):
        lo = max(0, at - MARGIN)
        place, gram, around = _anchors_of(data[lo : at + STRETCH + MARGIN])
        own = (place + lo >= at) & (place + lo < at + STRETCH)
        parts.append((place[own] + lo, gram[own], around[own]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if n < LEAST:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    sums, inverse = hash_sums(data)
    h = mixed((sums[GRAM:] - sums[: n - GRAM + 1]) * inverse[: n - GRAM + 1])
    least = _window_min(h, LEFT + 1)
    # a gram is an anchor if it equals the minimum of a window that holds it: the largest such minimum decides
    width = LEFT + 1
    spread = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    most = ~_window_min(~spread, width)
    at = np.flatnonzero(h == most)
    lo, hi = np.maximum(at - LEFT, 0), np.minimum(at + LEAST, n)
    around = mixed((sums[hi] - sums[lo]) * inverse[lo] + ((at - lo) * 1000 + (hi - at)).astype(np.uint64))
    return at, h[at], around


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in texts_of(batch):
            places, grams, rounds, count = [], [], [], []
            for text in texts:
                p, g, a = anchors(np.frombuffer(text, np.uint8))
                places.append(p)
                grams.append(g)
                rounds.append(a)
                count.append(len(p))
            which = pa.array(np.repeat(np.arange(len(texts)), count))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).slice(at, len(texts)).take(which) for c in range(3)], pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(rounds).view(np.int64))],
                names=["k1", "k2", "doc_id", "place", "gram", "around"],
            )


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around the places of each text (k1, k2, text, at: array of place, gram, around, first_id, kinds)."""
    schema = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("first_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])
    rows: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            raw, k1, k2 = batch.column(2)[i].as_py().encode(), batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for m in batch.column(3)[i].as_py():
                p = m["place"]
                rows.append((m["gram"], m["around"], m["first_id"], k1, k2, p, raw[max(0, p - LEFT) : p], raw[p : p + LEAST]))
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def group_spans(group: np.ndarray, order: np.ndarray, before: list[bytes], after: list[bytes], first: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes around each anchor that strings of LEAST bytes of its group cover: how many before it and after it (0, 0: none).

    ``group`` is the anchor's group, ``order`` the position of each anchor in reading order; its group matches strings that
    start ``low`` to ``high`` bytes before it. With ``first``, only strings that have an earlier match count; else those with
    a match anywhere.
    """
    n = len(group)
    left, right = np.array([len(b) for b in before]), np.array([len(a) for a in after])
    ahead = np.frombuffer(b"".join(a.ljust(LEAST, b"\xff") for a in after), np.uint8).reshape(n, LEAST)
    behind = np.frombuffer(b"".join(b.rjust(LEFT, b"\xff") for b in before), np.uint8).reshape(n, LEFT)
    _, dense = np.unique(group, return_inverse=True)
    keys = np.concatenate((dense.astype(">u4").view(np.uint8).reshape(n, 4), ahead), axis=1)
    sa = np.argsort(np.ascontiguousarray(keys).view(f"S{LEAST + 4}").ravel(), kind="stable")
    lcp = np.zeros(n, np.int64)
    differs = ahead[sa[1:]] != ahead[sa[:-1]]
    lcp[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), LEAST)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(right[sa[1:]], right[sa[:-1]]))
    lcp[1:][dense[sa[1:]] != dense[sa[:-1]]] = 0
    lowest, highest = np.full(n, LEAST), np.full(n, -1)
    for back in range(int(high.max(initial=0)) + 1):
        if back:
            # suffixes one byte longer: sorted by group and that byte, in the order of what follows; a step over others takes the least LCP
            has = left[sa] >= back
            key = dense[sa].astype(np.int64) * 256 + behind[sa, LEFT - back]
            place = np.flatnonzero(has)
            if len(place) < 2:
                break
            place = place[np.argsort(key[place], kind="stable")]
            same = key[place[1:]] == key[place[:-1]]
            step = np.zeros(len(place), np.int64)
            if same.any():
                a, b = place[:-1][same], place[1:][same]  # a < b: the sort is stable
                pairs = np.column_stack((a + 1, b + 1)).ravel()
                padded = np.concatenate((lcp, [0]))
                step[1:][same] = 1 + np.minimum.reduceat(padded, pairs)[::2]
            sa, lcp = sa[place], step
        hit = has_earlier(order[sa], lcp, LEAST)
        if not first:
            hit |= has_earlier(n - 1 - order[sa], lcp, LEAST)  # the mirrored factors: matches further on
        found = sa[hit & (low[sa] <= back) & (back <= high[sa])]
        lowest[found] = np.minimum(lowest[found], back)
        highest[found] = np.maximum(highest[found], back)
    return np.where(highest >= 0, highest, 0), np.where(highest >= 0, LEAST - lowest, 0)


def _match(first: bool):
    """Kernel over surroundings whose first column is their group."""

    def solve(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        order = np.empty(t.num_rows, np.int64)
        order[np.lexsort([t[c].to_numpy() for c in ("place", "k2", "k1", "first_id")])] = np.arange(t.num_rows)
        low, high = (t[c].to_numpy() if c in t.column_names else np.full(t.num_rows, all_of) for c, all_of in (("low", 0), ("high", LEFT)))
        lo, hi = group_spans(t.column(0).to_numpy(), order, t["before"].to_pylist(), t["after"].to_pylist(), first, low, high)
        keep = pa.array(np.flatnonzero(hi > 0))
        return pa.RecordBatch.from_arrays([t["gram"].combine_chunks().take(keep), t["around"].combine_chunks().take(keep), pa.array(lo.astype(np.int32)).take(keep), pa.array(hi.astype(np.int32)).take(keep)], names=["gram", "around", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by group; whole groups are solved, up to BLOCK rows of them at once."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = batch.column(0).to_numpy()
            cuts = np.flatnonzero(grams[1:] != grams[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != grams[0]:
                cuts = np.concatenate(([0], cuts))
            done = 0
            for cut in cuts.tolist():
                if rows + cut - done >= BLOCK:
                    held.append(batch.slice(done, cut - done))
                    yield solve(held)
                    held, rows, done = [], 0, cut
            held.append(batch.slice(done))
            rows += batch.num_rows - done
        if rows:
            yield solve(held)

    return run


SPANS = "gram long, around long, lo int, hi int"
_AT = ("first_id", "k1", "k2", "place")


def _split(rows: DataFrame, hot: int, first: bool) -> DataFrame:
    """Spans of anchors in more than ``hot`` surroundings (``rows``, as :func:`_surroundings` gives them).

    A string that starts ``low`` to ``high`` bytes before its anchor holds the ``low`` bytes before it and LEAST - ``high``
    from it on, so only surroundings that have these in common can share it, and they are sorted together. Groups that are
    still too large have their range of starts halved again, which makes what must be equal longer. With one start left
    the strings of a group are equal: all reach their neighbours, and the smallest position of all has no smaller one.
    """
    shared = F.concat(F.expr("substring(before, octet_length(before) - low + 1, low)"), F.expr(f"substring(after, 1, {LEAST} - high)"))
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
    columns = ["gram", "around", *_AT, "before", "after"]
    rows = rows.select(*columns, F.lit(0).alias("low"), F.lit(LEFT).alias("high"))
    at, spans, tables = F.struct(*_AT), [], []
    while True:
        dealt = rows.select(*columns, F.inline(halves)).where((F.octet_length("before") >= F.col("low")) & (F.octet_length("after") >= LEAST - F.col("high")))
        dealt = dealt.select(F.xxhash64("gram", "low", "high", shared).alias("group"), *columns, "low", "high")
        # written, so that the join deals both of its sides and a very large group can be split
        sizes = written(dealt.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "repeats-halves")
        now = written(dealt.join(sizes, "group"), "repeats-split")
        small = now.where(F.col("members") <= hot).drop("members").repartition("group").sortWithinPartitions("group")
        spans.append(written(small.mapInArrow(_match(first), SPANS), "repeats-spans"))
        large = now.where(F.col("members") > hot)
        equal = large.where("low = high").withColumn("string", shared)
        ends = equal.groupBy("group", "string").agg(F.min(at).alias("lo_at"), F.max(at).alias("hi_at")).where("lo_at <> hi_at")
        hit = equal.join(ends, ["group", "string"]).where(at != F.col("lo_at") if first else F.lit(True))
        spans.append(written(hit.select("gram", "around", F.col("low").alias("lo"), (LEAST - F.col("low")).alias("hi")), "repeats-spans"))
        for table in (sizes, *tables):
            dropped(table)
        rows, tables = large.where("low < high"), [now]
        if rows.isEmpty():
            break
    dropped(now)
    return functools.reduce(DataFrame.unionByName, spans).groupBy("gram", "around").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))


def without(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, bytes]:
    """How many runs the bytes [lo, hi) make, and the bytes outside them."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    starts, stops = lo[new], hi[np.concatenate((new[1:], [True]))]
    kept = [raw[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(raw)], strict=True)]
    return len(starts), b"".join(kept)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, cuts, n_alike (rows that are told alike) and n_whole (those of them that go whole, as copies)."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            doc_id, text, cuts, alike, whole = (batch.column(c)[i] for c in range(5))
            raw = text.as_py().encode()
            alike, whole = alike.as_py(), whole.as_py() if len(raw) >= LEAST else 0
            spans, kept = 0, raw
            if cuts.is_valid and whole < alike:
                lo = np.maximum(np.asarray(cuts.values.field("from")), 0)
                hi = np.minimum(np.asarray(cuts.values.field("to")), len(raw))
                ok = hi - lo >= LEAST
                if ok.any():
                    spans, kept = without(raw, lo[ok], hi[ok])
            rows += [(doc_id.as_py(), len(raw), len(raw) - len(kept), spans, kept)] * (alike - whole) + [(doc_id.as_py(), len(raw), len(raw), 1, b"")] * whole
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, keep: str = "none", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) for each row of ``docs`` (doc_id, text).

    Removes every byte that a string of LEAST bytes covers which also starts elsewhere, in any row; with keep="first"
    its first occurrence stays, by doc_id (null last), then hash of the text, then place. Strings are judged on the
    input. Null text is empty; null, empty and short texts lose nothing. Cuts may split a character, so the kept bytes
    are bytes. Ids play no part in what is removed but for that order: rows with null or repeated ids are rows like all
    others, and rows with equal texts match each other. Other columns of the input play no part. Very long texts are
    read in stretches. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    key = ["k1", "k2"]
    rows = rows.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"), "doc_id", "text")
    early = F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first_id")
    long_ones = rows.where(F.octet_length("text") >= LEAST)
    found = long_ones.mapInArrow(_anchors, "k1 long, k2 long, doc_id long, place int, gram long, around long")
    # grams at two places; written, so that the join deals both of its sides and a very frequent gram can be split
    spot = F.xxhash64("k1", "k2", "place")
    again = written(found.groupBy("gram").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).where("lo <> hi").select("gram"), "repeats-grams")
    met = written(found.join(again, "gram", "left_semi"), "repeats-met")
    marks = written(met.groupBy("gram", "around", "k1", "k2", "place").agg(early), "repeats-anchors")
    dropped(met)
    dropped(again)
    at = F.struct(*_AT)
    kinds = written(marks.groupBy("gram", "around").agg(F.min(at).alias("one"), F.max(at).alias("last")), "repeats-surroundings")
    sizes = written(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "repeats-open")
    open_kinds = kinds.join(sizes, "gram").select("gram", "around", "kinds", "one.*")
    asked = open_kinds.groupBy(key).agg(F.collect_list(F.struct("place", "gram", "around", "first_id", "kinds")).alias("at"))
    texts = long_ones.groupBy(key).agg(F.first("text").alias("text"))
    held = written(texts.join(asked, key).select("k1", "k2", "text", "at"), "repeats-texts")
    schema = "gram long, around long, first_id long, k1 long, k2 long, place int, before binary, after binary"
    some = lambda test: held.select("k1", "k2", "text", F.filter("at", test).alias("at")).where(F.size("at") > 0)
    sorted_groups = some(lambda m: m["kinds"] <= hot).mapInArrow(_surroundings, schema).repartition("gram").sortWithinPartitions("gram")
    spans = sorted_groups.mapInArrow(_match(keep == "first"), SPANS)
    if not sizes.where(F.col("kinds") > hot).isEmpty():
        large = written(some(lambda m: m["kinds"] > hot).mapInArrow(_surroundings, schema), "repeats-large")
        spans = spans.unionByName(_split(large, hot, keep == "first"))
        spans = written(spans, "repeats-spans")
        dropped(large)
    else:
        spans = written(spans, "repeats-spans")
    dropped(held)
    # a surrounding that occurs twice is covered whole
    cover = kinds.join(spans, ["gram", "around"], "left").withColumn("whole", F.col("one") != F.col("last")).where("whole or hi is not null")
    cover = written(cover.select("gram", "around", "one", "whole", "lo", "hi"), "repeats-cover")
    whole = F.col("whole") & (at != F.col("one")) if keep == "first" else F.col("whole")
    cut = marks.join(cover, ["gram", "around"]).withColumn("_w", whole).where("_w or hi is not null")
    lo, hi = F.when(F.col("_w"), F.lit(LEFT)).otherwise(F.col("lo")), F.when(F.col("_w"), F.lit(LEAST)).otherwise(F.col("hi"))
    cuts = cut.select(*key, F.struct((F.col("place") - lo).alias("from"), (F.col("place") + hi).alias("to")).alias("cut")).groupBy(key).agg(F.collect_set("cut").alias("cuts"))
    copies = long_ones.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), early).where("copies > 1")
    known = written(cuts.join(copies, key, "full").select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "cuts", "copies", "first_id"), "repeats-cuts")
    for table in (marks, kinds, sizes, spans, cover):
        dropped(table)
    same = (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))
    if keep == "first":
        # rows with one id and one text go together: at most one of them is the first
        told = rows.groupBy("k1", "k2", "doc_id").agg(F.first("text").alias("text"), F.count(F.lit(1)).cast("int").alias("alike")).join(known, same, "left")
        is_first = F.coalesce("doc_id", F.lit(NO_ID)) == F.col("first_id")
        n_whole = F.when(F.col("copies").isNull(), 0).when(is_first, F.col("alike") - 1).otherwise(F.col("alike"))
    else:
        told = rows.withColumn("alike", F.lit(1)).join(known, same, "left")
        n_whole = F.when(F.col("copies").isNull(), 0).otherwise(1)
    return told.select("doc_id", "text", "cuts", "alike", n_whole.alias("n_whole")).mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE: dict[str, str] = {}
