"""Byte-level BPE, encoding and decoding, with a vocabulary read from a rank file (one base64 token and its rank a line).

Bytes become Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds all tokens in a piece
in one pass. The encoder takes the longest token at each place and steps back to shorter ones, or to the token
before, wherever two neighbours could not both survive merging by rank. Whether two tokens can stand side by side
is decided on how each was merged, and remembered; each place fails at most once, so a piece takes linear time and
the result is exactly that of merging pairs by rank.

Pieces come from the vocabulary's pattern. Where a text has no two white-space characters in a row, pieces do
not cross spaces or line breaks, so the text is cut there and each distinct cut piece is encoded once; all other
texts go through the pattern whole. Ids of a slice are gathered by numpy.

Defined cases. A null text gives null ids, an empty one no ids. A null list of ids decodes to null, and so does one
that holds a null or an id outside the vocabulary, or whose bytes are not UTF-8 together. Rows stay one to one, repeated or not. Further
columns are carried; a result whose name is taken gets a leading underscore. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, other_names, text_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct units that a worker remembers before it starts anew.
REMEMBERED = 400_000


class Encoder:
    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in ranks.splitlines() if line.strip()))
        if [r for r, _ in pairs] != list(range(len(pairs))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        self.tokens = [t for _, t in pairs]
        self.ids = {t.decode("latin-1"): i for i, t in enumerate(self.tokens)}
        self.lengths = [len(t) for t in self.tokens]
        self.pattern = regex.compile(pattern)
        self.shorter = [next((self.ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.ids), -1) for s in self.ids]
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = []
        for i, s in enumerate(self.ids):
            left = self.shorter[i]
            while left >= 0:
                right = self.ids.get(s[self.lengths[left] :], i)
                if left < i and right < i and self._compatible(left, right):
                    self.pairs[left, right] = i
                    break
                left = self.shorter[left]
            self.parts.append((left, right) if left >= 0 else (i, i))
        self.known: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self.table = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.array(self.lengths, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a and b can be neighbours in a merged sequence: no merge across their border comes before those that made them."""
        limit = len(self.tokens)
        while True:
            merged = self.pairs.get((a, b))
            if merged is not None and merged < limit:
                return False
            # Undo the later of the two merges next to the border; single bytes can't be undone.
            if a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    if a == limit:
                        return True

    def _fits(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > 4 * REMEMBERED:
                self.known.clear()
            found = self.known[a, b] = self._compatible(a, b)
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 characters."""
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        longest = [-1] * (len(piece) + 1)
        for end, token in self.automaton.iter(piece):
            longest[end + 1 - self.lengths[token]] = token  # the last for a start is its longest
        open_, out, at, token = [True] * (len(piece) + 1), [], 0, longest[0]
        while at < len(piece):
            last = out[-1] if out else -1
            end = at + self.lengths[token] if token >= 0 else -1
            if token < 0:
                if last < 0:
                    raise ValueError("the vocabulary lacks single bytes")
                open_[at] = False
                out.pop()
                at -= self.lengths[last]
                token = last
            elif open_[end] and (last < 0 or self._fits(last, token)):
                out.append(token)
                at, token = end, longest[end]
            else:
                token = self.shorter[token]
        return tuple(out)

    def encode_text(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                ids = self.pieces[piece] = self.encode_piece(piece.encode("utf-8").decode("latin-1"))
            out += ids
        return out

    def _unit(self, unit: str) -> tuple[int, ...]:
        ids = self.units.get(unit)
        if ids is None:
            if len(self.units) >= REMEMBERED:
                self.units.clear()
            ids = self.units[unit] = tuple(self.encode_text(unit))
        return ids

    def encode(self, texts: pa.Array) -> pa.Array:
        """list<int32> of ids by text."""
        filled = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(filled, r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|^[ \n]|[ \n]$"), dtype=bool)
        plain = pc.replace_substring(pc.if_else(pa.array(odd), "", filled), "\n", " \n")
        split = pc.split_pattern(plain, " ")
        offsets = np.asarray(split.offsets, dtype=np.int64) - split.offsets[0].as_py()
        units = split.flatten().dictionary_encode()
        names = units.dictionary.to_pylist()
        index = np.asarray(units.indices, dtype=np.int64)
        # A unit after a space starts with it, unless it is a line break's; a text's first unit doesn't.
        first = np.zeros(len(index), bool)
        first[offsets[:-1]] = True
        index = index + len(names) * first
        used, index = np.unique(index, return_inverse=True)
        n = len(names)
        pieces = [() if not (u := names[k % n]) else self._unit(u if k >= n or u[0] == "\n" else " " + u) for k in used.tolist()]
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = np.fromiter((t for p in pieces for t in p), np.int32, int(lengths.sum()))
        per = lengths[index]
        starts = (np.cumsum(lengths) - lengths)[index]
        ends = np.concatenate([[0], np.cumsum(per)])
        ids = flat[np.repeat(starts - ends[:-1], per) + np.arange(ends[-1])] if len(per) else flat
        bounds = ends[offsets]
        if odd.any():
            parts, sizes = [], np.diff(bounds)
            for i, text in enumerate(filled.to_pylist()):
                parts.append(np.array(self.encode_text(text), np.int32) if odd[i] else ids[bounds[i] : bounds[i + 1]])
                sizes[i] = len(parts[-1])
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        mask = pc.is_null(texts)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=mask) if texts.null_count else pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids."""
        offsets = np.asarray(ids.offsets, dtype=np.int64) - ids.offsets[0].as_py()
        values = ids.values.slice(ids.offsets[0].as_py(), offsets[-1])
        flat = np.asarray(pc.fill_null(values, -1), dtype=np.int64)
        unknown = (flat < 0) | (flat >= len(self.tokens))
        seen = np.concatenate([[0], np.cumsum(unknown)])[offsets]
        void = (np.diff(seen) > 0) | np.asarray(pc.is_null(ids))
        flat = np.where(unknown, 0, flat)
        sizes = self.sizes[flat]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.table[np.repeat(self.starts[flat] - ends[:-1], sizes) + np.arange(ends[-1])] if len(flat) else self.table[:0]
        out = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends[offsets].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        try:
            out = out.cast(pa.string())
        except pa.ArrowInvalid:
            out = pa.array([_text(x) for x in out.to_pylist()], pa.string())
        return pc.if_else(pa.array(void), pa.scalar(None, pa.string()), out) if void.any() else out


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


_encoders: dict[str, Encoder] = {}


def encoder(ranks: bytes, pattern: str = PATTERN) -> Encoder:
    """The worker's encoder of this vocabulary, built once."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def _shipped(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """`df` with `tokens`, the ids of `text_col`. The vocabulary file is read on the driver and sent to the executors."""
    bound_batches(df.sparkSession)
    ranks, name = _shipped(df, vocabulary), other_names(df, "tokens")["tokens"]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value, pattern)
        for batch in text_slices(batches, text_col, 3 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, bpe.encode(batch.column(at))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, vocabulary: str = VOCABULARY, tokens_col: str = "tokens") -> DataFrame:
    """`df` with `decoded`, the text of the ids in `tokens_col`."""
    bound_batches(df.sparkSession)
    ranks, name = _shipped(df, vocabulary), other_names(df, "decoded")["decoded"]
    at = df.columns.index(tokens_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, bpe.decode(part.column(at))], names=[*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def encoded_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, restored): each text's ids, and whether decoding them gives the text again."""
    bound_batches(docs.sparkSession)
    ranks = _shipped(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value)
        for batch in text_slices(batches, "text", 3 << 20):
            ids = bpe.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pc.equal(bpe.decode(ids), batch.column("text"))], names=["doc_id", "tokens", "restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens array<int>, restored boolean")
