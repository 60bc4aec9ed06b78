"""SentencePiece encoding and decoding.

Encoding is Unigram Viterbi over a double-array trie of pieces with log scores. A character without a piece costs a
fixed penalty and becomes its UTF-8 bytes. Pieces of the vocabularies used here have the white-space marker only at
their start, so the best path breaks before every run of markers; the distinct stretches between such breaks are solved
together, position by position, in NumPy, and a text is the concatenation of its stretches. Decoding gathers the bytes
of pieces and turns markers into spaces.

A vocabulary of another kind (merges) has ranks in place of log scores; ranks become log probabilities by the
Zipf-Mandelbrot law. Scores are kept in units of 1/1024, so sums are exact and ties fall to the longer last piece.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_VALUES, POWER, POWER_INVERSE, mixed, powers, small_batches

#: The file of the vocabulary; a parameter of the operators.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the format: the marker, its stand-in byte (one that UTF-8 never has), and the penalty of a character without a piece.
MARKER = "▁".encode()
MARK = 0xFF
UNKNOWN_PENALTY = 10.0
UNIT = 1024
ZIPF_SHIFT = 2.7
#: Longer stretches are solved one at a time.
LOCKSTEP = 48
#: Free states that are tried for a set of children before it goes above all used ones.
TRIES = 32
#: Bytes of text that are encoded together: enough for words to repeat.
CHUNK = 1 << 20


@dataclasses.dataclass
class Pieces:
    """A vocabulary as arrays: the double array, a piece for each of its states, scores, and the bytes of each piece."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    unknown: int
    byte_id: np.ndarray
    is_byte: np.ndarray
    text_start: np.ndarray
    text_bytes: np.ndarray
    whole_stretches: bool

    @functools.cached_property
    def plain(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """The trie and the scores as lists, which loops over single bytes read faster."""
        return self.base.tolist(), self.check.tolist(), self.piece.tolist(), self.score.tolist()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "plain"}


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value arrays of a trie over bytes: state t is the child of s by byte c if t = base[s] + c + 1 and check[t] = s."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, value in keys.items():
        at = 0
        for c in key:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                values.append(-1)
            at = children[at][c]
        values[at] = value
    size = len(children) * 2 + 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    free, top = 257, 257  # the first free state above all labels, and one above all used ones
    queue = [(0, 0)]
    for node, state in queue:
        labels = sorted(children[node])
        if not labels:
            continue
        while check[free] >= 0:
            free += 1
        slot, tries = free, 0
        while True:
            b = slot - labels[0] - 1
            if b >= 0 and all(check[b + c + 1] < 0 for c in labels):
                break
            tries += 1
            slot = slot + 1 if tries < TRIES else max(slot + 1, top)
            while check[slot] >= 0:
                slot += 1
            if slot + 600 > len(check):
                base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
        base[state] = b
        for c in labels:
            child = children[node][c]
            check[b + c + 1] = state
            value[b + c + 1] = values[child]
            queue.append((child, b + c + 1))
        top = max(top, b + labels[-1] + 2)
        if max(labels) + b + 600 > len(check):
            base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


def load(path: str = MODEL) -> Pieces:
    """Reads a SentencePiece model file.

    Pieces that the user defined win over all others that cover the same characters. Texts are encoded as they are, with
    one marker in front, so a model that would change them first (rules of characters, runs of white space taken
    together, no marker in front) is refused.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise ValueError(f"the model {path} changes texts before it encodes them, which is not supported")
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    n = len(model.pieces)
    scores = np.array([p.score for p in model.pieces], dtype=np.float64)
    normal = np.array([p.type == kinds.NORMAL for p in model.pieces])
    if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.UNIGRAM:
        rank = np.empty(n)
        rank[np.argsort(-np.where(normal, scores, -np.inf), kind="stable")] = np.arange(1, n + 1)
        p = 1 / (rank + ZIPF_SHIFT)
        scores = np.log(p / p[normal].sum())
    units = np.round(scores * UNIT).astype(np.int64)
    for i, p in enumerate(model.pieces):
        if p.type == kinds.USER_DEFINED:
            units[i] = len(p.piece) * int(units[normal].max()) - UNIT // 10
    keys, texts, byte_id, is_byte = {}, [], np.full(256, -1, np.int32), np.zeros(n, bool)
    for i, p in enumerate(model.pieces):
        raw = p.piece.encode()
        if p.type == kinds.BYTE:
            value = int(p.piece[3:5], 16)
            byte_id[value], is_byte[i] = i, True
            texts.append(bytes([value]))
        elif p.type == kinds.UNKNOWN:
            texts.append(" ⁇ ".encode())
        elif p.type == kinds.CONTROL:
            texts.append(b"")
        else:
            keys[raw.replace(MARKER, bytes([MARK]))] = i
            texts.append(raw.replace(MARKER, b" "))
    base, check, piece = double_array(keys)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return Pieces(
        base, check, piece, units, int(units[normal].min()) - int(UNKNOWN_PENALTY * UNIT), byte_id, is_byte, starts, np.frombuffer(b"".join(texts), np.uint8),
        all(bytes([MARK]) not in k.lstrip(bytes([MARK])) for k in keys),
    )


def char_length(lead: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that starts with ``lead`` (the marker's stand-in has one)."""
    return np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, 1))))


def solve_one(p: Pieces, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and pieces (-1: bytes) of the best path of one stretch."""
    base, check, piece, score = p.plain
    n = len(raw)
    low = -(1 << 62)
    best, back, what = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0
    s = 0
    while s < n:
        lead = raw[s]
        width = min(1 if lead < 0xC0 or lead >= 0xF8 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4, n - s)
        state, single, e = 0, False, s
        while e < n:
            t = base[state] + raw[e] + 1
            if check[t] != state:
                break
            state, e = t, e + 1
            if piece[t] >= 0:
                value = best[s] + score[piece[t]]
                single |= e - s == width
                if value > best[e]:
                    best[e], back[e], what[e] = value, s, piece[t]
        if not single and best[s] + p.unknown > best[s + width]:
            best[s + width], back[s + width], what[s + width] = best[s] + p.unknown, s, -1
        s += width
    out, e = [], n
    while e:
        out.append((back[e], e, what[e]))
        e = back[e]
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out[::-1], strict=True))


def solve(p: Pieces, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best paths of many stretches of at most LOCKSTEP bytes: stretch, start, end and piece (-1: bytes) of each step, by stretch and start."""
    n, most = len(starts), int(lengths.max(initial=0))
    m = np.zeros((most + 1, n), dtype=np.uint8)
    for i in range(most):
        has = lengths > i
        m[i, has] = data[starts[has] + i]
    low = np.int64(-(1 << 62))
    best = np.full((most + 1, n), low)
    back, what = np.zeros((most + 1, n), np.int8), np.full((most + 1, n), -1, np.int32)
    best[0] = 0
    for s in range(most):
        lead = m[s]
        at = np.flatnonzero((lengths > s) & ((lead & 0xC0) != 0x80))
        if not len(at):
            continue
        width = np.minimum(char_length(lead[at]), lengths[at] - s)
        from_here = best[s, at]
        single = np.zeros(len(at), bool)
        going, state = np.arange(len(at)), np.zeros(len(at), np.int32)
        for e in range(s + 1, most + 1):
            inside = lengths[at[going]] >= e
            going, state = going[inside], state[inside]
            t = p.base[state] + m[e - 1, at[going]] + 1
            ok = p.check[t] == state
            going, state = going[ok], t[ok]
            if not len(going):
                break
            found = p.piece[state]
            has = found >= 0
            if has.any():
                g, f = going[has], found[has]
                single[g[e - s == width[g]]] = True
                value = from_here[g] + p.score[f]
                better = value > best[e, at[g]]
                where = at[g[better]]
                best[e, where], back[e, where], what[e, where] = value[better], s, f[better]
        g = np.flatnonzero(~single)
        value, end = from_here[g] + p.unknown, s + width[g]
        better = value > best[end, at[g]]
        end, where = end[better], at[g[better]]
        best[end, where], back[end, where], what[end, where] = value[better], s, -1
    steps, which, end = [], np.arange(n), lengths.astype(np.int64)
    while len(which):
        start = back[end, which].astype(np.int64)
        steps.append((which, start, end, what[end, which]))
        more = start > 0
        which, end = which[more], start[more]
    which, start, end, piece = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((start, which))
    return which[order], start[order], end[order], piece[order]


def encode(p: Pieces, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts and where each text's end. An empty text has none."""
    full = [bytes([MARK]) + t for t in texts if t]
    if not full:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    data = np.frombuffer(b"".join(full), np.uint8).copy()
    data[data == 0x20] = MARK
    doc_start = np.concatenate(([0], np.cumsum([len(t) for t in full])))
    mark = data == MARK
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    if not p.whole_stretches:  # such a vocabulary has no breaks but the ends of texts
        first[:] = False
    first[doc_start[:-1]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(starts, append=len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(POWER, len(data)), out=sums[1:])
    hashes = mixed((sums[starts + lengths] - sums[starts]) * powers(POWER_INVERSE, len(data))[starts] + lengths.astype(np.uint64))
    _, rep, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    # stretches that differ from their representative in spite of equal hashes are solved on their own
    same = lengths == lengths[rep][inverse]
    if same.all():
        shift = np.repeat(starts[rep][inverse] - starts, lengths) + np.arange(len(data))
        same = np.logical_and.reduceat(data[shift] == data, starts)
    if not same.all():
        rep, inverse = np.arange(len(starts)), np.arange(len(starts))
    u_start, u_length = starts[rep], lengths[rep]
    short = np.flatnonzero(u_length <= LOCKSTEP)
    parts = []
    short = short[np.argsort(u_length[short], kind="stable")]
    for group in np.array_split(short, max(1, len(short) // 50_000)):
        if len(group):
            which, s, e, piece = solve(p, data, u_start[group], u_length[group])
            parts.append((group[which], s, e, piece))
    for u in np.flatnonzero(u_length > LOCKSTEP):
        s, e, piece = solve_one(p, data[u_start[u] : u_start[u] + u_length[u]].tobytes())
        parts.append((np.full(len(s), u), s, e, piece))
    which, s, e, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(which, kind="stable")
    which, s, e, piece = which[order], s[order], e[order], piece[order]
    # characters without a piece become bytes
    times = np.where(piece < 0, e - s, 1)
    step = np.repeat(np.arange(len(piece)), times)
    inside = np.arange(len(step)) - np.repeat(np.cumsum(times) - times, times)
    ids = np.where(piece[step] < 0, p.byte_id[data[u_start[which[step]] + s[step] + inside]], piece[step]).astype(np.int32)
    count = np.bincount(which[step], minlength=len(rep))
    begin = np.cumsum(count) - count
    of = count[inverse]
    at = np.repeat(begin[inverse], of) + np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
    ends = np.cumsum(of)[np.searchsorted(starts, doc_start[1:]) - 1]
    out = np.zeros(len(texts), np.int64)
    out[[i for i, t in enumerate(texts) if t]] = np.diff(ends, prepend=0)
    return ids[at], np.cumsum(out)


def decode(p: Pieces, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The texts of pieces; the space that stands for the first marker goes."""
    start, stop = p.text_start[ids], p.text_start[ids + 1]
    size = stop - start
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    raw = p.text_bytes[at].tobytes()
    total = np.concatenate(([0], np.cumsum(size)))
    out, before = [], 0
    for end in total[ends].tolist():
        out.append(raw[before + (raw[before : before + 1] == b" ") : end] if end > before else b"")
        before = end
    return out


def encode_texts(docs: DataFrame, path: str = MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, pieces (array of ids), n_pieces, n_byte_pieces and round_trip for each row of ``docs``.

    round_trip tells whether decoding gives the text's bytes again; it does for every text, the marker character itself
    included, as that is spelled in bytes. Null and empty texts have no pieces. The vocabulary is read on the driver and
    sent to executors: it is bounded by the number of its pieces. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .near_dup import texts_of

        p = pieces.value
        for batch in batches:
            for at, texts in texts_of(batch, "text", CHUNK):
                ids, ends = encode(p, texts)
                counts = np.diff(ends, prepend=0)
                byte_sums = np.concatenate(([0], np.cumsum(p.is_byte[ids])))
                again = decode(p, ids, ends)
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.ListArray.from_arrays(offsets, pa.array(ids)),
                        pa.array(counts, pa.int64()),
                        pa.array(byte_sums[ends] - byte_sums[ends - counts], pa.int64()),
                        pa.array([a == t for a, t in zip(again, texts, strict=True)]),
                    ],
                    names=[key, "pieces", "n_pieces", "n_byte_pieces", "round_trip"],
                )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, pieces array<int>, n_pieces long, n_byte_pieces long, round_trip boolean")


def decode_pieces(rows: DataFrame, path: str = MODEL, pieces: str = "pieces", key: str = "doc_id") -> DataFrame:
    """key and text of each row of piece ids.

    Null gives null, no pieces an empty text, bytes that are no UTF-8 are replaced. Keys may be null or repeated, other
    columns play no part, an empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = np.asarray(column.flatten()).astype(np.int64)
            ends = np.cumsum(np.nan_to_num(np.asarray(column.value_lengths().fill_null(0))).astype(np.int64))
            found = decode(shared.value, flat, ends)
            texts = [None if not column[i].is_valid else t.decode("utf-8", "replace") for i, t in enumerate(found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, rows[pieces].alias("pieces")).mapInArrow(run, f"`{key}` {kind}, text string")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLE: dict[str, str] = {}
