"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks.

The kernel compares words by their subsequences of three symbols with gaps, which count less the longer they are, so an
insult with a changed or inserted letter stays close to itself. Punctuation inside words and spaces between single
letters are taken out first. Labels are on whole texts, but one word makes a text toxic: training picks, in rounds, the
word of each toxic text that the machine scores highest, against the words of clean texts.

A machine on Nystrom features of a kernel is linear in the kernel values to its landmarks, and these are linear in the
subsequences of a word. So the trained machine collapses into one table with a weight for each subsequence, and a text's
words are scored by table look-ups over its bytes. A text's score is the calibrated score of its worst word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import small_batches

#: The bounds of the training sample: so many labelled texts of each class, by order of a hash, and the bytes of each of them
#: (longer texts are scored like all others, but don't train).
TRAIN_OF_CLASS, TRAIN_BYTES = 3000, 32 << 10
LANDMARKS = 192
ROUNDS = 3
#: Words of clean texts that are instances of training, besides the hardest ones that each round adds.
NEGATIVES, HARD = 12_000, 3000
DECAY = 0.5
COST = 10.0
THRESHOLD = 0.3
#: Remainder of crc32(doc_id) modulo 4 of the rows that training never sees.
HELD_OUT = 2
#: Bytes that are scored together; a longer text is read in stretches that overlap by so many bytes.
CHUNK, OVERLAP = 256 << 10, 256

SPACE, OTHER, SYMBOLS = 0, 31, 32
#: The second and third symbol of a subsequence, counted from the first.
GAPS = [(a, b) for b in range(2, 5) for a in range(1, b)]


def _symbols() -> np.ndarray:
    """A symbol for each byte: white space, 26 letters, four classes of bytes beyond ASCII, and the rest. Digits that stand for letters are these letters."""
    out = np.full(256, OTHER, np.uint8)
    out[list(b" \t\n\x0b\x0c\r")] = SPACE
    for i in range(26):
        out[97 + i] = out[65 + i] = i + 1
    for digit, letter in zip(b"013457@", b"oieasta", strict=True):
        out[digit] = letter - 96
    out[128:] = 27 + (np.arange(128) & 3)
    return out


_SYMBOL = _symbols()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with one SPACE before each word and one at the end, where words start (at their SPACE), and the text of each word."""
    data = _SYMBOL[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    text = np.repeat(np.arange(len(texts) + 1), [len(t) + 1 for t in texts] + [1])[: len(data)]
    n = len(data)
    told = np.where(data == OTHER, 0, np.arange(n))
    left = data[np.maximum.accumulate(told)] == SPACE
    told = np.where(data == OTHER, n - 1, np.arange(n))
    right = data[np.minimum.accumulate(told[::-1])[::-1]] == SPACE
    # the rest's characters: white space at the ends of words, nothing inside
    data = np.where((data == OTHER) & (left | right), SPACE, data)
    keep = data != OTHER
    keep[1:] &= ~((data[1:] == SPACE) & (data[:-1] == SPACE))
    data, text = data[keep], text[keep]
    # a space with single letters on both sides, next to another such space, goes: "i d i o t"
    space = data == SPACE
    if len(data) > 4:
        single = np.zeros(len(data), bool)
        single[1:-1] = ~space[1:-1] & space[:-2] & space[2:]
        gap = np.zeros(len(data), bool)
        gap[1:-1] = space[1:-1] & single[:-2] & single[2:]
        gap[1:-1] &= text[:-2] == text[2:]
        spaced = gap.copy()
        spaced[2:] |= gap[:-2]
        spaced[:-2] |= gap[2:]
        near = np.zeros(len(data), bool)
        near[2:] |= gap[:-2]
        near[:-2] |= gap[2:]
        gone = gap & near
        data, text, space = data[~gone], text[~gone], space[~gone]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    return data, starts, text[starts + 1]


def subsequences(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: which places of ``data`` start such a subsequence, its code there, and its weight."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.int32)
    space = padded == SPACE
    high = padded[:n] << 10
    inner = np.zeros(n, bool)  # white space strictly inside
    for b in range(2, 5):
        inner = inner | space[b - 1 : b - 1 + n]
        ok = ~inner
        ok[max(0, n - b) :] = False
        for a in range(1, b):
            yield ok, high + (padded[a : a + n] << 5) + padded[b : b + n], DECAY ** (b - 2)


def scored(table: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The machine's value of each word, without its intercept. ``table``: (codes,) or (codes, m)."""
    n, wide = len(data), table.ndim == 2
    if not len(starts):
        return np.zeros((0, *table.shape[1:]), np.float32)
    total = np.zeros((n, *table.shape[1:]), np.float32)
    square = np.zeros(n, np.float32)
    for ok, code, weight in subsequences(data, starts):
        value = table[code] * np.float32(weight)
        total += np.where(ok[:, None] if wide else ok, value, np.float32(0))
        square += np.where(ok, np.float32(weight**2), np.float32(0))
    norm = np.sqrt(np.maximum(np.add.reduceat(square, starts), 1e-6))
    sums = np.add.reduceat(total, starts, axis=0)
    return sums / (norm[:, None] if wide else norm)


def profile(word: bytes) -> np.ndarray:
    """The normalized subsequence weights of a word that is given as symbols."""
    data = np.frombuffer(bytes([SPACE]) + word + bytes([SPACE]), np.uint8)
    out, square = np.zeros(SYMBOLS**3, np.float64), 0.0
    for ok, code, weight in subsequences(data, np.array([0])):
        np.add.at(out, code[ok], weight)
        square += ok.sum() * weight**2
    return (out / max(square, 1e-6) ** 0.5).astype(np.float32)


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Kernel values of words against landmarks."""
    table = np.stack([profile(w) for w in landmarks], axis=1)
    out = []
    for at in range(0, len(words), 2000):
        part = words[at : at + 2000]
        data = np.frombuffer(bytes([SPACE]) + bytes([SPACE]).join(part) + bytes([SPACE]), np.uint8)
        lengths = np.array([len(w) + 1 for w in part])
        out.append(scored(table, data, np.cumsum(lengths) - lengths))
    return np.concatenate(out) if out else np.zeros((0, len(landmarks)), np.float32)


def support_vector_machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights (the last is the intercept) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.column_stack((z, np.ones(len(z))))
    w = np.zeros(x.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    active = None
    for _ in range(30):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a = x[active] * weight[active, None]
        w = np.linalg.solve(np.diag(ridge) + cost * a.T @ x[active], cost * a.T @ y[active])
    return w


def calibrated(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through values, with Platt's softened targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack((value, np.ones(len(value))))
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (weight * (p - t)) + 1e-3 * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def overlapping(text: bytes) -> Iterator[bytes]:
    """Stretches of CHUNK bytes of a long text that start and end between words, OVERLAP or more bytes of each in the one before."""
    at = 0
    while True:
        to = at + CHUNK
        if to >= len(text):
            yield text[at:]
            return
        last = text.rfind(b" ", at + 2 * OVERLAP, to)
        to = last if last > 0 else to
        yield text[at:to]
        back = text.rfind(b" ", at + OVERLAP, to - OVERLAP)
        at = back if back > 0 else to - OVERLAP


class Machine:
    """The trained machine: a weight for each subsequence, an intercept, and a calibration."""

    def __init__(self, table: np.ndarray, intercept: float, slope: float, offset: float) -> None:
        self.table, self.intercept, self.slope, self.offset = table, intercept, slope, offset

    @property
    def has_learnt(self) -> bool:
        """Whether it tells texts apart; one without labels of both classes gives all the same score."""
        return bool(self.table.any())

    def values(self, texts: list[bytes]) -> np.ndarray:
        """The largest value of a word of each text; without words -1."""
        out, at = [np.zeros(0)], 0
        while at < len(texts):
            to, total = at, 0
            while to < len(texts) and (to == at or total + len(texts[to]) <= CHUNK):
                total += len(texts[to])
                to += 1
            if total <= CHUNK:
                out.append(self._values(texts[at:to]))
            else:  # one long text
                out.append(np.array([max(float(self._values([s])[0]) for s in overlapping(texts[at]))]))
            at = to
        return np.concatenate(out)

    def _values(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), -1.0)
        data, starts, of = words_of(texts)
        if len(starts):
            value = scored(self.table, data, starts).astype(np.float64) + self.intercept
            first = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[first]] = np.maximum.reduceat(value, first)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.values(texts) + self.offset, -35, 35)))


def train(texts: list[bytes], toxic: np.ndarray, prior: float) -> Machine:
    """A machine from texts with labels; ``prior`` is the share of toxic texts among all labelled ones."""
    toxic = np.asarray(toxic).astype(np.float64)
    share = min(max(prior, 1e-4), 1 - 1e-4)
    flat = Machine(np.zeros(SYMBOLS**3, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    if not 0 < toxic.sum() < len(toxic):
        return flat
    words_in: list[list[int]] = []
    number: dict[bytes, int] = {}
    for text in texts:
        data, starts, _ = words_of([text])
        found = {w for w in data.tobytes().split(bytes([SPACE])) if w}
        words_in.append([number.setdefault(w, len(number)) for w in sorted(found)])
    words = list(number)
    in_toxic, in_clean = np.zeros(len(words)), np.zeros(len(words))
    for ids, y in zip(words_in, toxic, strict=True):
        (in_toxic if y else in_clean)[ids] += 1
    if not in_toxic.any():
        return flat
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    odds = np.log((in_toxic + 0.5) / (n1 + 1)) - np.log((in_clean + 0.5) / (n0 + 1))
    value, seen = odds + 1e-6 * in_toxic, np.argsort(-in_clean, kind="stable")
    negatives = [i for i in seen[:NEGATIVES].tolist() if in_clean[i] > 0]
    hard: set[int] = set()
    table, intercept = flat.table, 0.0
    for turn in range(ROUNDS):
        witness = np.zeros(len(words))
        for ids, y in zip(words_in, toxic, strict=True):
            if y and ids:
                best = ids[int(np.argmax(value[ids]))]
                # one that clean texts use as well, or that hardly any toxic text has, says nothing of its text
                if odds[best] > 1:
                    witness[best] += 1
        positives = np.flatnonzero(witness)
        if not len(positives):
            return flat
        rest = [i for i in [*negatives, *sorted(hard)] if not witness[i]]
        if not rest:
            return flat
        marks = positives[np.argsort(-witness[positives], kind="stable")][: LANDMARKS // 2]
        spread = np.array(rest)[np.linspace(0, len(rest) - 1, min(len(rest), LANDMARKS - len(marks))).astype(int)]
        landmarks = [words[i] for i in [*marks, *dict.fromkeys(spread.tolist())]]
        members = [*positives.tolist(), *rest]
        k_nm, k_mm = kernel([words[i] for i in members], landmarks).astype(np.float64), kernel(landmarks, landmarks).astype(np.float64)
        scale, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
        strong = scale > 1e-6 * scale.max()
        root = vectors[:, strong] / np.sqrt(scale[strong])
        y = np.concatenate((np.ones(len(positives)), -np.ones(len(rest))))
        weight = np.concatenate((np.sqrt(witness[positives]), np.sqrt(1 + in_clean[rest])))
        weight[: len(positives)] /= weight[: len(positives)].sum() / 1000
        weight[len(positives) :] /= weight[len(positives) :].sum() / 1000
        w = support_vector_machine(k_nm @ root, y, weight)
        beta = root @ w[:-1]
        table = sum((b * profile(l).astype(np.float64) for b, l in zip(beta, landmarks, strict=True)), np.zeros(SYMBOLS**3)).astype(np.float32)
        intercept = float(w[-1])
        value = np.concatenate([_values(table, words[at : at + 20_000]) for at in range(0, len(words), 20_000)]) + intercept
        clean = np.flatnonzero(in_clean > 0)
        hard |= set(clean[np.argsort(-value[clean], kind="stable")][:HARD].tolist())
    machine = Machine(table, intercept, 1.0, 0.0)
    best = np.concatenate([machine.values(texts[at : at + 200]) for at in range(0, len(texts), 200)])
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    return Machine(table, intercept, *calibrated(best, toxic, weight))


def _values(table: np.ndarray, words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(bytes([SPACE]) + bytes([SPACE]).join(words) + bytes([SPACE]), np.uint8)
    lengths = np.array([len(w) + 1 for w in words])
    return scored(table, data, np.cumsum(lengths) - lengths).astype(np.float64)


def held_out(doc_id):
    """Whether training must not see a row."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, of_class: int = TRAIN_OF_CLASS) -> Machine:
    """Trains on at most ``of_class`` labelled texts of each class, none of them held out.

    Rows with a null label or id are left out, a text with two labels is toxic, of the texts with one id the least is
    taken, and without texts of both classes the machine gives every text the share of toxic labels. The sample has a
    bound (TRAIN_OF_CLASS texts of a class, TRAIN_BYTES of each), so it may go to every task and the driver.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    share = known.agg(F.avg(F.col("_toxic").cast("double"))).first()[0] or 0.0
    order = F.xxhash64("_id")
    sample = known.where("_toxic = 1").orderBy(order, "_id").limit(of_class).unionByName(known.where("_toxic = 0").orderBy(order, "_id").limit(of_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").alias("_text")).where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= TRAIN_BYTES)
    # a repeated id gives one row, however many there are
    rows = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic")).collect()
    rows.sort(key=lambda r: r[0])
    return train([(r[1] or "").encode() for r in rows], np.array([r[2] for r in rows]), share)


def _scored(docs: DataFrame, machine: Machine, carry: list[str]) -> DataFrame:
    """(row, score): the columns ``carry`` of ``docs`` as one struct that holds the text, so that a text travels once."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    place = carry.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .near_dup import texts_of

        for batch in batches:
            row = batch.column(0)
            texts = pa.RecordBatch.from_arrays([row.field(place)], names=["text"])
            scores = [shared.value.scores(group) for _, group in texts_of(texts)]
            yield pa.RecordBatch.from_arrays([row, pa.array(np.concatenate([*scores, np.zeros(0)]))], names=["row", "score"])

    source = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"))
    return source.mapInArrow(run, StructType([*source.schema.fields, StructField("score", DoubleType())]))


def score_texts(docs: DataFrame, machine: Machine, carry: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``carry`` and a score from 0 to 1 for each row of ``docs``; the score's name wins over a column of ``docs``.

    Null and empty texts get the score of a text without words, the lowest. Null and repeated ids are as good as others,
    very long texts are read in overlapping stretches, equal texts have equal scores, an empty table gives no rows.
    """
    names = [c for c in carry if c != name]
    return _scored(docs, machine, [*dict.fromkeys([*names, "text"])]).select(*[F.col("row")[c].alias(c) for c in names], F.col("score").alias(name))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the texts that score ``threshold`` or more.

    All columns stay, whatever their names; the texts travel with their rows, so no join is needed. Null and empty texts
    stay, rows with null or repeated ids are judged by their own text, an empty table gives no rows. Where the labels
    teach nothing, all rows stay.
    """
    machine = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    if not machine.has_learnt:
        return docs
    return _scored(docs, machine, docs.columns).where(F.col("score") < threshold).select("row.*")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = score_texts(docs, machine)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE: dict[str, str] = {}
