"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The encoder never merges pairs. An Aho-Corasick automaton over all tokens gives the longest token at each
position of a piece; tokens are taken from left to right, and a token is accepted only next to a token it is
compatible with, which a table of the pairs behind each merge decides. Where it is not, the next shorter token
is tried, and where none is left the last token is taken back; a position found useless is never tried again,
so a piece takes linear time. The result is exactly that of applying the merges in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from exposura.llm.text_kernel import released

# The split of a byte-level vocabulary, before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Distinct pieces, and pairs of tokens, a task remembers; beyond that it forgets them all and starts again.
REMEMBERED = 200_000
# Texts that are encoded or decoded at a time.
_ROWS = 256
# A longer text is split piece by piece instead of as one list.
_LONG = 2_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as is, others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tables of one vocabulary file. Tokens are known inside by their rank: 256 bytes, then merges in order."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        if model["type"] != "BPE" or file["pre_tokenizer"]["type"] != "ByteLevel" or file.get("normalizer"):
            raise ValueError("only byte-level BPE vocabularies without a normalizer are supported")
        letters = byte_letters()
        self.to_letters = {b: letters[b] for b in range(256)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.tokens = letters + [a + b for a, b in merges]
        self.rank = {token: at for at, token in enumerate(self.tokens)}
        if len(self.rank) != len(self.tokens):
            raise ValueError("two merges give the same token")
        self.halves = [(r, r) for r in range(256)] + [(self.rank[a], self.rank[b]) for a, b in merges]
        self.merged = {pair: 256 + at for at, pair in enumerate(self.halves[256:])}
        self.ids = np.array([model["vocab"][t] for t in self.tokens], np.int32)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.added = {}
        for token in file.get("added_tokens") or []:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("added tokens that take in white space are not supported")
            self.added[token["content"]] = token["id"]
        self.lengths = [len(t) for t in self.tokens]
        self.shorter: dict[int, int] = {}
        self.fits = _Pairs(self)
        self.pieces = _Pieces(self)
        self.split = regex.compile(PATTERN)
        self.around = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def next_shorter(self, rank: int) -> int:
        """The longest token that is a proper prefix of a token; -1 where there is none."""
        found = self.shorter.get(rank)
        if found is None:
            token = self.tokens[rank]
            found = next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), -1)
            self.shorter[rank] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side: no earlier merge joins what meets at their border."""
        limit = len(self.tokens)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        word = piece.decode("latin-1").translate(self.to_letters)
        size, lengths, fits = len(word), self.lengths, self.fits
        longest = [-1] * (size + 1)
        # matches come by ascending end, so the last one seen for a start is its longest
        for end, rank in self.automaton.iter(word):
            longest[end - lengths[rank] + 1] = rank
        useful = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < size:
            end = at + lengths[token]
            if useful[end] and (last < 0 or fits[last, token]):
                out.append(token)
                at, last, token = end, token, longest[end]
                continue
            token = self.next_shorter(token)
            if token < 0:
                useful[at] = 0
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.around is None:
            return self._plain(text)
        parts, at = [], 0
        for match in self.around.finditer(text):
            parts += [self._plain(text[at:match.start()]), np.array([self.added[match.group()]], np.int32)]
            at = match.end()
        return np.concatenate([*parts, self._plain(text[at:])]) if parts else self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        found: Iterable[str] = (
            self.split.findall(text) if len(text) < _LONG else (m.group() for m in self.split.finditer(text))
        )
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, found)), np.int32)


class OffsetTable:
    """The bytes of all tokens in the order of their ids, and where each begins."""

    def __init__(self, text: str):
        file = json.loads(text)
        of_letter = {letter: byte for byte, letter in enumerate(byte_letters())}
        by_id = {i: bytes(of_letter[c] for c in token) for token, i in file["model"]["vocab"].items()}
        by_id.update({token["id"]: token["content"].encode() for token in file.get("added_tokens") or []})
        lengths = np.zeros(max(by_id) + 2, np.int64)
        for i, token in by_id.items():
            lengths[i + 1] = len(token)
        self.offsets = np.cumsum(lengths)
        self.bytes = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        if not len(ids):
            return ""
        places = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])
        return self.bytes[places].tobytes().decode("utf-8", "replace")


class _Pairs(dict):
    """Answers of ``compatible`` given so far."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[pair] = self.vocabulary.compatible(*pair)
        return value


class _Pieces(dict):
    """Ids of the pieces seen so far, as bytes of 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        value = self.vocabulary.ids[self.vocabulary.encode_piece(piece.encode())].tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = value
        return value


@lru_cache(maxsize=1)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


@lru_cache(maxsize=1)
def _offset_table(text: str) -> OffsetTable:
    return OffsetTable(text)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """A few rows at a time, so that a task holds the tokens of a few texts only."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _file(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and sent to the executors; a file of a few megabytes."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def bpe_encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column of token ids: those of the vocabulary file at ``path``, none added.

    With ``decoded``, a further column holds what the ids decode to, worked out beside them in the same task.
    A null or empty text gives no ids. The strings of added tokens become their ids where a text holds them.
    Other columns, rows and repeated rows stay as they are; columns called like the new ones are replaced.
    """
    file = _file(docs, path)
    added = [ids] if decoded is None else [ids, decoded]
    kept = [c for c in docs.columns if c not in added]
    place = kept.index(text)

    def work(batches):
        vocabulary = _vocabulary(file.value)
        for batch in _parts(batches):
            lists = [vocabulary.encode(t) for t in batch.column(place).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)])))
            columns = [*batch.columns, column]
            if decoded is not None:
                columns.append(pa.array([_offset_table(file.value).decode(one) for one in lists], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    kinds = (T.ArrayType(T.IntegerType()), T.StringType())
    new = [T.StructField(name, kind) for name, kind in zip(added, kinds)]
    return rows.mapInArrow(released(work), T.StructType([*rows.schema.fields, *new]))


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with a column of the text its ids stand for; null ids give an empty text."""
    file = _file(encoded, path)
    kept = [c for c in encoded.columns if c != text]
    place = kept.index(ids)

    def work(batches):
        table = _offset_table(file.value)
        for batch in _parts(batches):
            column = batch.column(place)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [
                table.decode(flat[a:b].astype(np.int64)) if ok else ""
                for a, b, ok in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text])

    rows = encoded.select(*[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(released(work), T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
