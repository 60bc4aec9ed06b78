"""MinHash near-duplicate detection with odd sketches.

Words become 5-word shingles, a document's shingle set gets MinHash samples. Rows of samples are banded into buckets;
all samples are also folded into an odd sketch, a bitmap of parities. The XOR of two sketches has a population count
that estimates the size of the symmetric difference of the sample sets, which is precise where similarity is high, and
this verifies the candidates of the bands before the full shingle sets confirm them.

No bucket is expanded into its pairs. Documents with equal shingle sets are one node. In a bucket every node is first
paired with the smallest one; the confirmed links give components. Only a bucket of three nodes or more that still
spans components can hide a link between them. Such buckets make clusters, and the nodes of a cluster are compared in
blocks: sketch against sketch, then set against set, passing over pairs whose components are joined already, so that a
block gives at most one link for each component that it joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, POWER, POWER_INVERSE, SPACES, dropped, mixed, powers, small_batches, written

WORDS = 5
#: A link: 100 * |A & B| >= percent * |A | B|; PERCENT unless a caller gives another, OP_PERCENT in op2_near_dedup.
PERCENT, OP_PERCENT = 80, 85
SAMPLES = 128
#: All bands together may miss a pair at the limit with this probability.
MISS = 1e-6
SKETCH_BITS = 1024
#: Standard errors of the estimate that a candidate may lie below the limit.
MARGIN = 5.0
#: Nodes of a cluster that are compared with as many others at once, and shingles that they have on average at most.
BLOCK, BLOCK_SHINGLES = 2048, 2 << 20
#: Bytes of text that are hashed together; a longer text goes in stretches that end at white space.
CHUNK = 256 << 10

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_SPACE = re.compile(b"[%s]" % SPACES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * POWER) | np.uint64(1)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another, and the words of each text.

    ``data`` holds the bytes with a space after each text, ``ends`` where each text with its space ends.
    """
    data = _LOWER[data]
    space = _IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    # A polynomial in POWER: terms with the power of the place, summed by prefix, then moved to the start of the word.
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(POWER, len(data)), out=sums[1:])
    hashes = mixed((sums[stops] - sums[starts]) * powers(POWER_INVERSE, len(data))[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def stretches(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about CHUNK bytes that end before white space, so no word is cut; a longer word stays whole."""
    at = 0
    while len(text) - at > CHUNK:
        space = _IS_SPACE[np.frombuffer(text, np.uint8, CHUNK, at)]
        cut = CHUNK - 1 - int(np.argmax(space[::-1]))
        if not space[cut]:
            found = _SPACE.search(text, at + CHUNK)
            cut = (found.start() if found else len(text)) - at
        if cut:
            yield text[at : at + cut]
        at += cut + 1
    yield text[at:]


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and how many each has."""
    if sum(map(len, texts)) <= 2 * CHUNK:
        return word_hashes(np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8), np.cumsum([len(t) + 1 for t in texts]))
    found = [[word_hashes(np.frombuffer(s + b" ", np.uint8), np.array([len(s) + 1]))[0] for s in stretches(t)] for t in texts]
    return np.concatenate([h for parts in found for h in parts]), np.array([sum(map(len, parts)) for parts in found])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: of five words, or of all words where there are fewer."""
    words, counts = _words_of(texts)
    n = len(words)
    out = []
    if n >= WORDS:
        shingles = np.zeros(n - WORDS + 1, dtype=np.uint64)
        for j in range(WORDS):
            shingles = mixed(shingles + words[j : n - WORDS + 1 + j])
    at = 0
    for count in counts.tolist():
        if count >= WORDS:
            found = np.sort(shingles[at : at + count - WORDS + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif count:
            value = np.uint64(count)
            with np.errstate(over="ignore"):
                for w in words[at : at + count]:
                    value = mixed(value + w)
            out.append(np.array([value], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += count
    return out


def banding(percent: int) -> tuple[int, int]:
    """Rows and bands of the samples: the most rows with which all bands miss a pair at the limit no oftener than MISS (5 and 25 at 85, 4 and 32 at 80)."""
    fit = [r for r in range(1, SAMPLES + 1) if (1 - (percent / 100) ** r) ** (SAMPLES // r) <= MISS]
    rows = max(fit, default=1)
    return rows, SAMPLES // rows


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (n, bands) and odd sketches (n, words of 64 bits) of non-empty sets."""
    lengths = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    every = np.concatenate(sets)
    samples = np.empty((SAMPLES, len(sets)), dtype=np.uint64)
    for i, seed in enumerate(_SEEDS):
        samples[i] = np.minimum.reduceat(every * seed, starts)
    rows, count = banding(percent)
    bands = np.empty((count, len(sets)), dtype=np.uint64)
    for b in range(count):
        value = np.full(len(sets), b + 1, dtype=np.uint64)
        for r in range(rows):
            value = mixed(value + samples[b * rows + r])
        bands[b] = value
    bits = mixed(samples + _SEEDS[:, None]) % np.uint64(SKETCH_BITS)
    parity = np.zeros((len(sets), SKETCH_BITS), dtype=np.uint8)
    which = np.broadcast_to(np.arange(len(sets)), bits.shape)
    np.add.at(parity, (which.ravel(), bits.ravel().astype(np.int64)), 1)
    sketches = np.packbits(parity & 1, axis=1).view(">u8").astype(np.uint64)
    return bands.T, sketches


def most_odd_bits(percent: int = PERCENT) -> int:
    """The largest XOR population count of sketches that a link can have, MARGIN standard errors included."""
    limit = percent / 100
    low = max(0.0, limit - MARGIN * (limit * (1 - limit) / SAMPLES) ** 0.5)
    differing = 2 * SAMPLES * (1 - low)
    return int(SKETCH_BITS * (1 - np.exp(-2 * differing / SKETCH_BITS)) / 2 + MARGIN * (SKETCH_BITS / 4) ** 0.5 / 2)


def texts_of(batch: pa.RecordBatch, name: str = "text", chunk: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as bytes (null: empty), in groups of about ``chunk`` bytes with the first row's number."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    at, group, total = 0, [], 0
    for i, value in enumerate(column):
        raw = value.as_py() or b""
        group.append(raw)
        total += len(raw)
        if total >= chunk:
            yield at, group
            at, group, total = i + 1, [], 0
    if group:
        yield at, group


def _sign(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        for at, texts in texts_of(batch):
            sets = shingle_sets(texts)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands, sketches = signatures([sets[i] for i in full], percent) if full else (np.zeros((0, 1)), np.zeros((0, 1)))
            place = dict(zip(full, range(len(full)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([bands[place[i]].view(np.int64) if i in place else None for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([sketches[place[i]].view(np.int64) if i in place else None for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "key", "bands", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in texts_of(batch):
            sets = shingle_sets(texts)
            values = pa.array(np.concatenate(sets).view(np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, values)], names=["node", "set"])


def odd_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _cross_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between components that two blocks of one cluster hold: at most one for each two components that it joins.

    Sketches go first, full sets confirm, and pairs whose components are joined already are passed over.
    """
    table = table.combine_chunks()
    side, node = np.asarray(table["side"]), np.asarray(table["node"])
    _, label = np.unique(np.asarray(table["comp"]), return_inverse=True)
    sketch = np.array(table["sketch"].combine_chunks().flatten()).view(np.uint64).reshape(len(node), -1)
    lists = table["set"].combine_chunks()
    values, bounds = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    size = np.diff(bounds)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right if len(right) else left  # a block against itself
    most, out = most_odd_bits(percent), []
    for i in left:
        odd = np.bitwise_count(sketch[right] ^ sketch[i]).sum(axis=1)
        alike = (odd <= most) & (label[right] != label[i])
        alike &= 100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i])
        own = values[bounds[i] : bounds[i + 1]]
        for j in right[alike][np.argsort(odd[alike], kind="stable")]:
            if label[j] != label[i]:
                both = len(np.intersect1d(own, values[bounds[j] : bounds[j + 1]], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
                    label[label == label[j]] = label[i]
    found = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, comp) for nodes of undirected ``edges`` (a, b): comp is the smallest node that can be reached.

    Alternating large-star and small-star steps; each replaces edges by edges to smaller nodes, so hubs are keys of
    aggregations and joins, never lists. Every round is written to the shared folder.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    before = None
    while True:
        # large star: larger neighbours of a node go to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small_least, "b")
        small = joined.select(F.col("m").alias("x"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("y"))
        old, edges = edges, written(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), name)
        dropped(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text), linked from ``percent`` of similarity on.

    Documents without words (null, empty or only white space) have no shingles and are linked with nothing; so are
    rows whose doc_id is null: their component_id is null and they are kept. Rows that repeat a doc_id are one
    document: what any of its texts is linked with, all are. Ties cannot arise: the smallest doc_id is kept. Very long
    texts are hashed in stretches. Other columns of the input play no part. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    signed = written(docs.mapInArrow(lambda batches: _sign(batches, percent), "doc_id long, n long, key binary, bands array<long>, sketch array<long>"), "neardup-signatures")
    first = F.min(F.struct("doc_id", "n", "sketch", "bands"))
    nodes = signed.where("key is not null and doc_id is not null").groupBy("key").agg(first.alias("f")).select("key", F.col("f.doc_id").alias("node"), "f.n", "f.sketch", "f.bands")
    nodes = written(nodes, "neardup-nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = written(banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1"), "neardup-buckets")
    members = written(banded.join(buckets, "bucket").select("bucket", "node", "pivot", "nodes"), "neardup-members")
    sketches = nodes.select("node", "sketch")
    of_pivot = sketches.select(F.col("node").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
    pairs = members.where("node <> pivot").select("pivot", "node").distinct().join(sketches, "node").join(of_pivot, "pivot")
    pairs = written(pairs.where(odd_bits(F.col("sketch"), F.col("pivot_sketch")) <= most_odd_bits(percent)).select(F.col("pivot").alias("a"), F.col("node").alias("b")), "neardup-pairs")
    # the sets of all nodes that this pass or the next may compare
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.where("nodes > 2").select("node")).distinct()
    # merge joins at every size: a small side that is broadcast would only hide what the texts cost on larger inputs
    texts = docs.join(wanted.hint("merge"), docs["doc_id"] == wanted["node"]).select("node", "text")
    sets = written(texts.mapInArrow(_sets, "node long, set array<long>"), "neardup-sets")
    links = written(linked(pairs, sets, percent), "neardup-links")
    comps = components(links, "neardup-star")
    # buckets that still span components; those that share a node are one cluster, so a node is in one only
    labelled = members.where("nodes > 2").join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    open_buckets = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("first")).where("lo <> hi")
    rest = written(labelled.join(open_buckets, "bucket").select("node", "comp", "first").distinct(), "neardup-open")
    clusters = components(rest.select(F.col("node").alias("a"), F.col("first").alias("b")), "neardup-clusters").select("node", F.col("comp").alias("cluster"))
    weighed = clusters.join(nodes.select("node", "n"), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = weighed.groupBy("cluster").agg(blocks.alias("blocks"))
    rows = rest.select("node", "comp").distinct().join(clusters, "node").join(sizes, "cluster").join(sketches, "node").join(sets.hint("merge"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "comp", "sketch", "set")
    more = written(dealt.groupBy("cluster", "i", "j").applyInArrow(lambda rows: _cross_links(rows, percent), "a long, b long"), "neardup-more")
    if not more.isEmpty():
        comps = components(links.unionByName(more), "neardup-star2")
    of_key = nodes.select("key", "node").join(comps, "node", "left").select(F.col("key").alias("_key"), F.coalesce("comp", "node").alias("comp"))
    out = signed.select("doc_id", "n", "key").join(of_key, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets reach the limit."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").where(both * 100 >= union * percent).select("a", "b").distinct()


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component.

    All columns stay, whatever their names. Rows whose doc_id is null stay, as do documents without words; rows that
    repeat a kept doc_id stay all; null, empty and very long texts and empty tables are as in :func:`near_duplicates`.
    """
    marks = near_duplicates(docs.select("doc_id", "text"), percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = rows.join(marks, F.col("row")["doc_id"].cast("long") == F.col("kept_id"), "left_semi")
    return rows.where(F.col("row")["doc_id"].isNull()).unionByName(kept).select("row.*")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), OP_PERCENT)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.d)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id, r.c = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT d, min(c) AS c FROM reach GROUP BY d) r ON r.d = d.doc_id
"""

QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLE = {"op2_near_dedup": SQL}
