"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Every piece of a text (the pre-tokenizer's pattern cuts them) is encoded from left to right: take
the longest token that starts here; if it can't stand after the token before it, take the next
shorter one; if none can, take back the token before. Two tokens can stand side by side if the
merges would really leave this boundary, which a table of checked pairs remembers. Each position
is given up at most once, so the time is linear, and the result is exactly that of the merges.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from staylens.llm.frames import add_columns, ship
from staylens.llm.words import byte_texts

# Fixed value: the public pattern by which byte-level vocabularies of this family cut texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pattern for texts of ASCII and these letters only, where plain ranges will do.
LATIN_LETTERS = "À-ÖØ-öø-ÿ"
SIMPLE_PATTERN = (
    rf" ?[A-Za-z{LATIN_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+"
    rf"| ?[^ \t\n\v\f\rA-Za-z0-9{LATIN_LETTERS}]+|[ \t\n\v\f\r]+(?![^ \t\n\v\f\r])|[ \t\n\v\f\r]+"
)

# Entries that a task's piece cache and pair table hold before they start anew.
CACHE_ENTRIES = 400_000
# Longer pieces are encoded without being remembered.
CACHED_PIECE = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabulary files, by rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file; its size is the vocabulary's."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]],
                 special: dict[str, int]):
        self.tokens = tokens
        self.merges = merges
        self.special = special

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Reads a ``tokenizers`` file of byte-level BPE with the pattern above."""
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
        ids = content["model"]["vocab"]
        tokens = {
            bytes(alphabet[c] for c in text): i
            for text, i in ids.items() if text not in special
        }
        merges = []
        for merge in content["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            merges.append((ids[left], ids[right], ids[left + right]))
        return cls(tokens, merges, special)


class Codec:
    """Encoder and decoder tables of a vocabulary; a task builds them once."""

    def __init__(self, vocabulary: Vocabulary):
        tokens = vocabulary.tokens
        self._bytes = {i: token for token, i in tokens.items()}
        self._special = vocabulary.special
        # A merge's rank is its place in the list; a pair that appears twice keeps the first.
        self._merged: dict[tuple[int, int], tuple[int, int]] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._rank: dict[int, int] = {}
        for rank, (left, right, whole) in enumerate(vocabulary.merges):
            self._merged.setdefault((left, right), (rank, whole))
            if whole not in self._parts:
                self._parts[whole] = (left, right)
                self._rank[whole] = rank
        self._matcher = ahocorasick.Automaton()
        for token, i in tokens.items():
            self._matcher.add_word(token.decode("latin-1"), (i, len(token)))
        self._matcher.make_automaton()
        self._size = [0] * (max(self._bytes) + 1)
        self._furthest = max(map(len, tokens))
        self._shorter = [-1] * (max(self._bytes) + 1)
        for token, i in tokens.items():
            self._size[i] = len(token)
            self._shorter[i] = self._longest_proper_prefix(token, tokens)
        self._can_stand: dict[tuple[int, int], bool] = {}
        self._pieces = _Pieces(self)
        self._cut = regex.compile(PATTERN).findall
        self._cut_simple = re.compile(SIMPLE_PATTERN).findall
        self._not_simple = re.compile(f"[^\x00-\x7f{LATIN_LETTERS}]").search
        # Offset table: token i is blob[offsets[i]:offsets[i + 1]].
        by_id = self._bytes | {i: text.encode() for text, i in self._special.items()}
        ordered = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self._blob = np.frombuffer(b"".join(ordered), np.uint8)
        self._offsets = np.concatenate([[0], np.cumsum([len(t) for t in ordered])])

    @staticmethod
    def _longest_proper_prefix(token: bytes, tokens: dict[bytes, int]) -> int:
        for end in range(len(token) - 1, 0, -1):
            if token[:end] in tokens:
                return tokens[token[:end]]
        return -1

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave a boundary between two tokens that are adjacent.

        The merges that build either token are undone from the last to the first. Whenever the
        pieces that then touch at the boundary have a merge of their own which comes before the
        merge undone last, that merge would have crossed the boundary.
        """
        a, b, found = left, right, True
        a_rank, b_rank = self._rank.get(a, -1), self._rank.get(b, -1)
        # Merges of equal rank are done from left to right: one across the boundary comes before
        # the same merge further right, and after the same merge further left.
        undone, undone_right = None, False
        while True:
            crossing = self._merged.get((a, b))
            if crossing is not None and (
                undone is None
                or crossing[0] < undone
                or (crossing[0] == undone and undone_right)
            ):
                found = False
                break
            if a_rank < 0 and b_rank < 0:
                break
            if a_rank > b_rank:
                undone, undone_right = a_rank, False
                a = self._parts[a][1]
                a_rank = self._rank.get(a, -1)
            else:
                undone, undone_right = b_rank, True
                b = self._parts[b][0]
                b_rank = self._rank.get(b, -1)
        if len(self._can_stand) >= CACHE_ENTRIES:
            self._can_stand.clear()
        self._can_stand[left, right] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece of a text."""
        size, shorter, known, compatible = self._size, self._shorter, self._can_stand, self._compatible
        text = piece.decode("latin-1")
        # Longest match by start, along the greedy run; other starts are matched when they come up.
        longest = {end + 1 - n: token for end, (token, n) in self._matcher.iter_long(text)}
        ids: list[int] = []
        given_up: set[int] = set()
        start, token, before = 0, longest[0], -1
        while True:
            end = start + size[token]
            if end not in given_up:
                fits = True if before < 0 else known.get((before, token))
                if compatible(before, token) if fits is None else fits:
                    ids.append(token)
                    if end == len(text):
                        return ids
                    if end not in longest:
                        near = self._matcher.iter_long(text[end : end + self._furthest])
                        longest[end] = next(near)[1][0]
                    start, before, token = end, token, longest[end]
                    continue
            next_token = shorter[token]
            while next_token < 0:
                given_up.add(start)
                token = ids.pop()
                before = ids[-1] if ids else -1
                start -= size[token]
                next_token = shorter[token]
            token = next_token

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if not any(special in text for special in self._special):
            return self._encode_plain(text)
        cut = regex.compile("(" + "|".join(map(regex.escape, self._special)) + ")")
        return b"".join(
            self._special[part].to_bytes(4, "little") if part in self._special
            else self._encode_plain(part)
            for part in cut.split(text)
        )

    def _encode_plain(self, text: str) -> bytes:
        cut = self._cut if self._not_simple(text) else self._cut_simple
        return b"".join(map(self._pieces.__getitem__, cut(text)))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the text that the ids stand for; broken characters become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        starts = self._offsets[numbers]
        lengths = self._offsets[numbers + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        joined = self._blob[places].tobytes()
        return joined.decode("utf-8", "replace").encode()


class _Pieces(dict):
    """Encoded pieces by their text, bounded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self._codec = codec

    def __missing__(self, piece: str) -> bytes:
        found = self._codec.encode_piece(piece.encode())
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= CACHED_PIECE:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


def encoder(vocabulary: Vocabulary) -> Codec:
    """The vocabulary's codec, built once a process and kept with it."""
    if not hasattr(vocabulary, "codec"):
        vocabulary.codec = Codec(vocabulary)
    return vocabulary.codec


def encode_texts(frame: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """All columns and ``ids`` (array of int): the text's tokens; a null text has none.

    The vocabulary is broadcast; its size is the file's, whatever the data. No shuffle.
    """
    shared = ship(frame.sparkSession, vocabulary)

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        codec = encoder(shared())

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = [codec.encode(t or "") for t in batch.column(0).to_pylist()]
            return {"ids": _int_lists(rows)}

        return work

    return add_columns(frame, [text], "ids array<int>", make)


def decode_ids(frame: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded``: the text that the ids stand for; null ids give an empty one."""
    shared = ship(frame.sparkSession, vocabulary)

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        codec = encoder(shared())

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = [np.array(r or [], "<u4").tobytes() for r in batch.column(0).to_pylist()]
            return {"decoded": pa.array([codec.decode(r).decode() for r in rows], pa.string())}

        return work

    return add_columns(frame, [ids], "decoded string", make)


def round_trip_digests(
    frame: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Columns ``keep`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text.

    Encodes and decodes in one pass, without handing the ids through Spark. Null and empty texts
    have no tokens and the digests of nothing. Repeated rows each give a row.
    """
    shared = ship(frame.sparkSession, vocabulary)

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        codec = encoder(shared())

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            counts, ids_hex, text_hex = [], [], []
            for value in byte_texts(batch.column(0)):
                ids = codec.encode((value or b"").decode("utf-8", "replace"))
                counts.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return {
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(ids_hex, pa.string()),
                "decoded_sha256": pa.array(text_hex, pa.string()),
            }

        return work

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return add_columns(frame, [text], added, make, keep)


def _int_lists(rows: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
