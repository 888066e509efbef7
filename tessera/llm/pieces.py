"""Piece encoding and decoding with a vocabulary of scored pieces.

The best segmentation under the pieces' log scores is found by Viterbi over
a double-array trie.  Characters without a piece fall back to byte pieces;
spaces are carried by the marker U+2581, and one is put before the text if
the vocabulary says so.  Segmentations never cross from a word into the next
space when no piece does, so each distinct word of a batch is solved once,
all words together position by position.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Piece types of the model format, and how far an unknown
#: character scores below the lowest piece.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Characters of text in work at a time, words remembered, and bytes up to
#: which words are solved together; they bound memory, not results.
BLOCK, REMEMBERED, TOGETHER = 1 << 20, 100_000, 96
WORDS = re.compile(r" *[^ ]+| +\Z")


def _fields(buf: bytes):
    """(number, value) of every field of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            b = buf[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, buf[i:i + size]
            i += size


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and the double array over those that text can match: from state
    s, byte b leads to t = base[s] + b if check[t] == s."""

    pieces: list[bytes]
    byte_id: np.ndarray
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    unknown_score: float
    unknown_id: int
    prefix: bool
    by_word: bool
    spelled: list[int]


def _double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes: list[dict[int, int]] = [{}]
    leaf = {}
    for key, i in keys.items():
        at = 0
        for b in key:
            at = nodes[at].setdefault(b, len(nodes))
            if at == len(nodes):
                nodes.append({})
        leaf[at] = i
    size = 2 * len(nodes) + 1024
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    state = {0: 0}
    first = [1] * 9  # where to look for room, by the number of children
    for node, below in enumerate(nodes):  # parents come before their children
        s = state[node]
        piece[s] = leaf.get(node, -1)
        if not below:
            continue
        codes = np.array(sorted(below))
        free = first[min(len(codes), 8)]
        while True:
            if free + 512 >= len(check):
                grow = np.full(len(check), -1, np.int32)
                base, check, piece = np.append(base, grow * 0), np.append(check, grow), np.append(piece, grow)
            if check[free] < 0 and free > codes[0] and (check[free - codes[0] + codes] < 0).all():
                break
            free += 1
        first[min(len(codes), 8)] = free
        base[s] = free - codes[0]
        check[base[s] + codes] = s
        for b in codes.tolist():
            state[below[b]] = int(base[s]) + b
    end = int(np.flatnonzero(check >= 0).max()) + 1 + 256
    pad = max(0, end - len(check))
    return tuple(np.append(x, np.full(pad, fill, np.int32))[:end] for x, fill in ((base, 0), (check, -1), (piece, -1)))


@lru_cache(maxsize=4)
def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a piece model file.  Only models that leave characters as they
    are (no normalisation table, spaces kept) are accepted."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, kinds, prefix = [], [], [], True
    for number, value in _fields(raw):
        if number == 1:
            got = dict(_fields(value))
            pieces.append(got[1].decode())
            scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
            kinds.append(got.get(3, NORMAL))
        elif number == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError(f"{path}: text normalisation is not supported")
    return vocabulary(pieces, scores, kinds, prefix)


def vocabulary(pieces: list[str], scores: list[float], kinds: list[int], prefix: bool = True) -> Vocabulary:
    keys, byte_id, raw = {}, np.full(256, -1, np.int32), []
    for i, (p, kind) in enumerate(zip(pieces, kinds)):
        raw.append(b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode())
        if kind == BYTE:
            byte_id[int(p[3:5], 16)] = i
            raw[i] = bytes([int(p[3:5], 16)])
        elif kind in (NORMAL, USER):
            keys.setdefault(raw[i], i)
    base, check, piece = _double_array(keys)
    score = np.where(piece >= 0, np.asarray(scores)[piece], np.nan)
    lowest = min((scores[i] for i in keys.values()), default=0.0)
    return Vocabulary(raw, byte_id, base, check, piece, score, lowest - UNKNOWN_PENALTY,
                      kinds.index(UNKNOWN) if UNKNOWN in kinds else -1, prefix,
                      not any(re.search(rb"[^ ] ", k) for k in keys), byte_id.tolist())


def _char_length(first):
    return 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)


def _ids(v: Vocabulary, data: bytes, cuts) -> list[int]:
    """Ids of a path of (start, end, piece or -1); unknown characters become bytes."""
    out = []
    for a, b, p in cuts:
        if p >= 0:
            out.append(p)
        else:
            spelled = [v.spelled[x] for x in data[a:b]]
            out += spelled if min(spelled) >= 0 else [v.unknown_id]
    return out


def encode_one(v: Vocabulary, data: bytes) -> list[int]:
    """Viterbi over one word, position by position; of equal paths the one
    whose last piece starts first wins."""
    n = len(data)
    best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] == -np.inf:
            continue
        size, s, single = int(_char_length(data[i])), 0, False
        for j in range(i, n):
            t = int(v.base[s]) + data[j]
            if v.check[t] != s:
                break
            s = t
            if v.piece[s] >= 0:
                single |= j + 1 - i == size
                got = best[i] + float(v.score[s])
                if got > best[j + 1]:
                    best[j + 1], back[j + 1] = got, (i, int(v.piece[s]))
        if not single and best[i] + v.unknown_score > best[i + size]:
            best[i + size], back[i + size] = best[i] + v.unknown_score, (i, -1)
    cuts, at = [], n
    while at:
        cuts.append((back[at][0], at, back[at][1]))
        at = back[at][0]
    return _ids(v, data, cuts[::-1])


def _encode_together(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The same for many words of like length at once; zero bytes, which no
    piece holds, fill the shorter ones."""
    sizes = np.array([len(w) for w in words])
    n, many = int(sizes.max()), len(words)
    grid = np.frombuffer(b"".join([w.ljust(n, b"\0") for w in words]), np.uint8).reshape(-1, n).T.astype(np.int64)
    best = np.full((n + 1, many), -np.inf)
    start, piece = np.zeros((n + 1, many), np.int64), np.full((n + 1, many), -1, np.int32)
    best[0] = 0
    unmatched = np.empty(many, bool)
    for i in range(n):
        row = np.flatnonzero((sizes > i) & (best[i] > -np.inf))
        if not len(row):
            continue
        unmatched[row] = True
        size = _char_length(grid[i])
        at, s = row, np.zeros(len(row), np.int32)
        for j in range(i, n):
            t = v.base[s] + grid[j][at]
            ok = v.check[t] == s
            at, s = at[ok], t[ok]
            if not len(at):
                break
            p = v.piece[s]
            full = p >= 0
            r, p = at[full], p[full]
            unmatched[r[size[r] == j + 1 - i]] = False
            got = best[i][r] + v.score[s[full]]
            won = got > best[j + 1][r]
            r = r[won]
            best[j + 1][r], start[j + 1][r], piece[j + 1][r] = got[won], i, p[won]
        r = row[unmatched[row]]
        end = i + size[r]
        got = best[i][r] + v.unknown_score
        won = got > best[end, r]
        r, end = r[won], end[won]
        best[end, r], start[end, r], piece[end, r] = got[won], i, -1
    steps, at, row = [], sizes, np.arange(many)
    while len(row):  # all paths back to the start together
        steps.append((row, at, start[at, row], piece[at, row]))
        at = steps[-1][2]
        row, at = row[at > 0], at[at > 0]
    owner, end, begin, p = (np.concatenate(x)[::-1] for x in zip(*steps))
    order = np.argsort(owner, kind="stable")
    owner, p, cuts = owner[order], p[order], np.searchsorted(owner[order], np.arange(many + 1)).tolist()
    ids = p.astype(np.int32).tobytes()
    out = [ids[4 * a:4 * b] for a, b in zip(cuts, cuts[1:])]
    end, begin = end[order], begin[order]
    for w in np.unique(owner[p < 0]).tolist():
        a, b = cuts[w], cuts[w + 1]
        cut = zip(begin[a:b].tolist(), end[a:b].tolist(), p[a:b].tolist())
        out[w] = np.array(_ids(v, words[w], cut), np.int32).tobytes()
    return out


def encode_words(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids of each word, as the bytes of 32-bit integers."""
    out: list = [None] * len(words)
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) > TOGETHER:
            out[i] = np.array(encode_one(v, w), np.int32).tobytes()
        else:
            by_size.setdefault((len(w) + 3) // 4, []).append(i)
    for group in by_size.values():
        for lo in range(0, len(group), 8_000):
            part = group[lo:lo + 8_000]
            for i, ids in zip(part, _encode_together(v, [words[k] for k in part])):
                out[i] = ids
    return out


class Encoder:
    """Encodes texts, remembering words it has solved."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}

    def __call__(self, text: str) -> np.ndarray:
        return self.texts([text])[0]

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; new words of about BLOCK characters are solved together."""
        out: list[list] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            for part in self._parts(text):
                held.append((i, WORDS.findall(part) if self.v.by_word else [part]))
                size += len(part)
                if size > BLOCK:
                    self._solve(held, out)
                    held, size = [], 0
        self._solve(held, out)
        return [None if t is None else np.concatenate(got) if got else np.zeros(0, np.int32)
                for t, got in zip(texts, out)]

    def _parts(self, text: str | None):
        """The text with its prefix, cut where a word has ended if it is long."""
        if not text:
            return
        text, at = (" " if self.v.prefix else "") + text.replace(MARK, " "), 0
        while at < len(text):
            end = len(text)
            if self.v.by_word and end - at > BLOCK:
                m = re.compile(r"[^ ](?= )").search(text, at + BLOCK)
                end = m.end() if m else end
            yield text[at:end]
            at = end

    def _solve(self, held, out) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({w for _, words in held for w in words if w not in known})
        known.update(zip(new, encode_words(self.v, [w.encode("utf-8", "surrogatepass") for w in new])))
        for i, words in held:
            out[i].append(np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32))


def encode(docs: DataFrame, text_col: str = "text", vocabulary: Vocabulary | None = None) -> Column:
    """array<int> column of piece ids; null text: null; empty text: no ids.

    The vocabulary (its size is fixed by its file) is broadcast to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for texts in batches:
            yield pd.Series(encoder.texts(list(texts)), dtype=object)

    return ids(F.col(f"`{text_col}`"))


def decode_ids(v: Vocabulary, ids) -> str:
    data = b"".join([v.pieces[i] for i in ids])
    return data.decode("utf-8", "replace")[1 if v.prefix and data[:1] == b" " else 0:]


def decode(docs: DataFrame, ids_col: str = "ids", vocabulary: Vocabulary | None = None) -> Column:
    """Text of piece ids: byte pieces are joined to characters, markers become
    spaces, the prefix space is dropped; control and unknown pieces spell
    nothing.  Null ids: null.  Every text without U+2581 comes back exactly
    if the vocabulary has all byte pieces; U+2581 comes back as a space."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        v = shared.value
        return pd.Series([None if x is None else decode_ids(v, x.tolist()) for x in ids], dtype=object)

    return text(F.col(f"`{ids_col}`"))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     vocabulary: Vocabulary | None = None) -> DataFrame:
    """(id, n_tokens, n_bytes, ids, round_trip) of every document.

    ``n_bytes`` counts byte pieces; ``round_trip`` says whether decoding gives
    the text back (null for a null text, whose ids are null and n_tokens 0).
    Repeated rows each get their row; an empty table gives none.
    """
    v = vocabulary or load_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(v)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    fields = rows.select("id").schema.add("n_tokens", "integer").add("n_bytes", "integer").add("ids", ArrayType(IntegerType())) \
        .add("round_trip", "boolean")
    return rows.mapInArrow(_encoded(shared), fields).withColumnRenamed("id", id_col)


def _encoded(shared):
    def run(batches):
        encoder = Encoder(shared.value)
        v = encoder.v
        spelled = v.byte_id[v.byte_id >= 0]
        for batch in batches:
            size = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(1).cast(pa.binary())), 0).cast("int64"))
            cuts = np.flatnonzero(np.diff(size.to_numpy(zero_copy_only=False) // BLOCK)) + 1
            for part in map(batch.slice, [0, *cuts], np.diff([0, *cuts, batch.num_rows])):
                texts = part.column(1).to_pylist()
                ids = encoder.texts(texts)
                n = np.array([0 if x is None else len(x) for x in ids], np.int32)
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                offsets = np.append(0, np.cumsum(n)).astype(np.int32)
                total = np.append(0, np.cumsum(np.isin(flat, spelled)))
                mask = pa.array([t is None for t in texts], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)
                same = pa.array([None if x is None else decode_ids(v, x.tolist()) == t for x, t in zip(ids, texts)], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array((total[offsets[1:]] - total[offsets[:-1]]).astype(np.int32)),
                     lists, same], ["id", "n_tokens", "n_bytes", "ids", "round_trip"])
    return run
