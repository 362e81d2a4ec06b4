"""Passages that repeat across or inside texts, by column-wise sorting of aligned suffixes.

Any two equal strings of ``length`` bytes hold the same anchor at the same place: the start of the
gram whose hash is smallest among the grams of the string. So every window of a text belongs to one
anchor, and equal windows to anchors of equal grams. Texts are cut into pieces, one for each run of
windows with a common anchor whose gram occurs again somewhere.

The pieces of one gram are a collection of short documents, aligned at their anchors. It is built
column by column from the right: each round inserts one symbol of every document that reaches the
column, sorts the documents' suffixes from here by that symbol (stably, on top of the order of the
column before: a step of the Burrows-Wheeler transform) and updates the common prefixes of
neighbours. Windows of different columns cannot be equal, so columns need not be merged with each
other. Two neighbours with a common prefix of ``length`` bytes are equal windows.

The same on words instead of bytes finds the texts that share a run of words with another text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.frames import add_columns, batch_rows, slices, unused
from staylens.llm.words import byte_texts
from staylens.sources.durable import durable, release

LENGTH = 400
GRAM = 32
# Words of a gram, where the windows are runs of words.
GRAM_WORDS = 8
# Distinct pieces of one gram that one task sorts; the windows of larger groups are counted by hash.
GROUP_PIECES = 30_000
# Pieces that one round of columns handles together, groups being whole.
ROUND_PIECES = 8192
# Bytes of a text whose anchors are found at once; a place must fit in the low bits of a key.
PLACE_BITS = 20
STEP = 1 << (PLACE_BITS - 1)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_IN_WORD = np.array([not bytes([byte]).isspace() for byte in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int, powers: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each gram of the bytes; equal grams have equal hashes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + 1) * powers[:n], out=sums[1:])
    return _mixed((sums[gram:] - sums[: n - gram + 1]) * inverses[: n - gram + 1])


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each run of ``width`` keys."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class WordHashes:
    """Hashes of the words of texts, a word being a run of bytes that are no ASCII white space."""

    def __init__(self) -> None:
        self.powers, self.inverses = _powers(_BASE, 0), _powers(_INVERSE, 0)

    def of(self, text: bytes) -> np.ndarray:
        parts, begin = [np.zeros(0, np.uint64)], 0
        while begin < len(text):
            blank = _BLANK.search(text, begin + STEP)  # a part ends where a word does
            end = blank.start() if blank else len(text)
            parts.append(self._part(text[begin:end]))
            begin = end
        return parts[1] if len(parts) == 2 else np.concatenate(parts)

    def _part(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        if len(data) >= len(self.powers):
            self.powers, self.inverses = _powers(_BASE, 2 * len(data)), _powers(_INVERSE, 2 * len(data))
        edges = np.flatnonzero(np.diff(_IN_WORD[data], prepend=False, append=False))
        firsts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + 1) * self.powers[: len(data)], out=sums[1:])
        return _mixed((sums[ends] - sums[firsts]) * self.inverses[firsts])


class Anchors:
    """Finds the anchors of texts; tables of powers are built once a task."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.powers = _powers(_BASE, STEP + 2 * length)
        self.inverses = _powers(_INVERSE, STEP + 2 * length)

    def of(self, text: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each run of windows with one anchor: gram hash, anchor, first and last window start.

        A text is its bytes, or an array of symbols.
        """
        text = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
        found = [self._part(text, begin) for begin in range(0, max(len(text) - self.length + 1, 0), STEP)]
        if not found:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, empty
        return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))

    def _part(self, text: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
        data = text[begin : begin + STEP + self.length - 1]
        hashes = gram_hashes(data, self.gram, self.powers, self.inverses)
        place_bits = np.uint64(PLACE_BITS)
        keys = (hashes >> place_bits << place_bits) | np.arange(len(hashes), dtype=np.uint64)
        least = _window_minima(keys, self.length - self.gram + 1)
        anchors = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        firsts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        lasts = np.append(firsts[1:], len(anchors)) - 1
        chosen = anchors[firsts]
        return hashes[chosen].view(np.int64), chosen + begin, firsts + begin, lasts + begin


def _numbered_words(pieces: list[list[bytes]]) -> np.ndarray:
    """The pieces' words one after another, equal words as equal numbers."""
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(word, len(known)) for piece in pieces for word in piece], np.int64)
    return numbers.astype(np.uint16) if len(known) < 1 << 16 else numbers


def equal_windows(
    group: np.ndarray, pieces: list[bytes] | list[list[bytes]], anchors: np.ndarray, length: int,
    owners: np.ndarray | None = None,
) -> np.ndarray:
    """Places (piece, window start in it) of windows that another piece of the same group also has.

    ``group`` is sorted; ``anchors`` are the places of the anchors in the pieces. A piece is bytes
    or a list of words. With ``owners``, only windows count that pieces of different owners have.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    in_bytes = not len(pieces) or isinstance(pieces[0], bytes)
    data = np.frombuffer(b"".join(pieces), np.uint8) if in_bytes else _numbered_words(pieces)
    groups = np.unique(group, return_inverse=True)[1]
    small = len(groups) and int(groups[-1]) < 1 << 16
    groups = groups.astype(np.uint16 if small else np.int64)
    right = sizes - anchors  # columns that each piece reaches, the anchor's being 0
    left = -anchors
    order = np.zeros(0, np.int64)
    common = np.zeros(0, np.int16)  # of the suffix from here with that of the piece before
    found: list[np.ndarray] = []
    entering = np.argsort(-right, kind="stable")
    entered = 0
    for column in range(int(right.max(initial=0)) - 1, int(left.min(initial=0)) - 1, -1):
        # Pieces whose last symbol is in this column come in first of all, with nothing in common.
        new = entered
        while new < len(entering) and right[entering[new]] > column:
            new += 1
        if new > entered:
            order = np.concatenate([entering[entered:new], order])
            common = np.concatenate([np.zeros(new - entered, np.int16), common])
            if len(common) > new - entered:
                common[new - entered] = 0
            entered = new
        inside = left[order] <= column
        if not inside.all():
            # A piece that has ended goes; what its neighbours have in common goes through it.
            keep = np.flatnonzero(inside)
            if not len(keep):
                order, common = order[:0], common[:0]
                continue
            common = np.minimum.reduceat(common[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
            common[0] = 0
            order = order[keep]
        if not len(order):
            continue
        symbols = data[starts[order] + anchors[order] + column]
        by_symbol = np.argsort(symbols, kind="stable")
        moved = by_symbol[np.argsort(groups[order[by_symbol]], kind="stable")]
        same = np.zeros(len(moved), bool)
        same[1:] = (symbols[moved[1:]] == symbols[moved[:-1]]) & (
            groups[order[moved[1:]]] == groups[order[moved[:-1]]]
        )
        updated = np.zeros(len(moved), np.int16)
        after = np.flatnonzero(same)
        if len(after):
            bounds = np.empty(2 * len(after), np.int64)
            bounds[::2] = moved[after - 1] + 1
            bounds[1::2] = moved[after] + 1
            least = np.minimum.reduceat(np.append(common, common[:1]), bounds)[::2]
            updated[after] = np.minimum(least, length - 1) + 1
        order, common = order[moved], updated
        hit = common >= length
        if hit.any():
            if owners is None:
                hit[:-1] |= hit[1:]
            else:
                firsts = np.flatnonzero(~hit)
                own = owners[order]
                several = np.minimum.reduceat(own, firsts) != np.maximum.reduceat(own, firsts)
                hit = several[np.cumsum(~hit) - 1]
            of = order[hit]
            found.append(np.stack([of, anchors[of] + column], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _runs(marked: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """First and last of each run of marked starts, by piece."""
    order = np.lexsort((marked[:, 1], marked[:, 0]))
    piece, place = marked[order, 0], marked[order, 1]
    breaks = np.flatnonzero((piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1))
    firsts = np.concatenate([[0], breaks + 1])
    lasts = np.append(breaks, len(piece) - 1)
    runs: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        runs.setdefault(int(piece[a]), []).append((int(place[a]), int(place[b])))
    return runs


def _anchor_rows(texts: DataFrame, length: int, gram: int, in_words: bool = False) -> DataFrame:
    """``tid``, ``gram``, ``anchor``, ``first`` and ``last`` of each run of windows, in bytes or words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, hashes = Anchors(length, gram), WordHashes()
        for batch in slices(batches):
            rows, parts = [], []
            for row, text in enumerate(byte_texts(batch.column(1))):
                if text is not None and len(text) >= length:
                    found = anchors.of(hashes.of(text) if in_words else text)
                    rows.append(np.full(len(found[0]), row))
                    parts.append(found)
            if not parts:
                continue
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            tids = batch.column(0).take(pa.array(np.concatenate(rows), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [tids, *[pa.array(c, pa.int64()) for c in columns]],
                ["tid", "gram", "anchor", "first", "last"],
            )

    return texts.mapInArrow(run, "tid binary, gram long, anchor long, first long, last long")


def _piece_rows(texts: DataFrame, length: int, in_words: bool = False) -> DataFrame:
    """``tid``, ``first``, ``last``, ``gram``, ``digest``, ``anchor`` (in the piece), ``piece`` of each run.

    ``piece`` is null where the task has given the same piece before. Places are bytes or words;
    the words of a piece have a blank between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for part in slices(batches, 64):
            rows = []
            tids = part.column(0).to_pylist()
            for tid, text, runs in zip(tids, byte_texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                text = text.split() if in_words else text
                for r in runs:
                    piece = text[r["first"] : r["last"] + length]
                    piece = b" ".join(piece) if in_words else piece
                    place = r["anchor"] - r["first"]
                    digest = hashlib.blake2b(piece, digest_size=16, salt=place.to_bytes(4, "little")).digest()
                    fresh = digest not in given
                    if fresh:
                        if len(given) >= 200_000:
                            given.clear()
                        given.add(digest)
                    rows.append((tid, r["first"], r["last"], r["gram"], digest, place, piece if fresh else None))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], _PIECE_NAMES
                )

    return texts.mapInArrow(
        run, "tid binary, first long, last long, gram long, digest binary, anchor int, piece binary"
    )


_PIECE_NAMES = ["tid", "first", "last", "gram", "digest", "anchor", "piece"]
_PIECE_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]


def _sorted_pieces(
    length: int, in_words: bool = False
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From pieces sorted by gram to the runs of window starts that a piece shares with others.

    In words, the pieces have owners, and those of one owner are not others.
    """

    def owners(rows: list[tuple]) -> np.ndarray:
        known: dict[bytes, int] = {}
        # Several texts have a piece without an owner: it is another's to any piece.
        return np.array([-1 - i if r[4] is None else known.setdefault(r[4], len(known)) for i, r in enumerate(rows)])

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        group = np.array([r[0] for r in rows], np.int64)
        pieces = [r[3].split() if in_words else r[3] for r in rows]
        places = np.array([r[2] for r in rows], np.int64)
        marked = equal_windows(group, pieces, places, length, owners(rows) if in_words else None)
        if not len(marked):
            return None
        runs = _runs(marked)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[p][0] for p in runs], pa.int64()),
                pa.array([rows[p][1] for p in runs], pa.binary()),
                pa.array([[x for run in runs[p] for x in run] for p in runs], pa.list_(pa.int32())),
            ],
            ["gram", "digest", "shared"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups, and the one being read
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and group[0][0] != row[0]:
                    if len(group) > 1:
                        held += group
                    group = []
                    if len(held) >= ROUND_PIECES:
                        solved = solve(held)
                        held = []
                        if solved is not None:
                            yield solved
                group.append(row)
        if len(group) > 1:
            held += group
        solved = solve(held) if held else None
        if solved is not None:
            yield solved

    return run


def _hot_windows(pieces: DataFrame, length: int) -> DataFrame:
    """The same runs for groups too large for a task: windows are hashed and counted instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, digest, anchor, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                starts = range(len(piece) - length + 1)
                hashes = [hashlib.blake2b(piece[s : s + length], digest_size=16).digest() for s in starts]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([gram] * n, pa.int64()), pa.array([digest] * n, pa.binary()),
                        pa.array(starts, pa.int32()), pa.array([anchor - s for s in starts], pa.int32()),
                        pa.array(hashes, pa.binary()),
                    ],
                    ["gram", "digest", "start", "offset", "window"],
                )

    windows = pieces.select("gram", "digest", "anchor", "piece").mapInArrow(
        run, "gram long, digest binary, start int, offset int, window binary"
    )
    key = ["gram", "offset", "window"]
    common = durable(windows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
    return windows.join(common, key).groupBy("gram", "digest").agg(
        F.flatten(F.collect_list(F.array("start", "start"))).alias("shared")
    )


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``tid`` and ``spans`` (flat first and last starts of repeated windows) of texts with any.

    ``texts`` has ``tid`` (of equal texts the same) and ``text``. Texts that occur more than once
    need not be found here: the caller knows them.
    """
    spark = texts.sparkSession
    anchors = durable(_anchor_rows(texts, length, gram))
    places = anchors.select("tid", "gram", "anchor").distinct()
    again = durable(places.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    kept = anchors.distinct().join(again, "gram", "left_semi")
    by_text = durable(
        kept.groupBy("tid").agg(F.collect_list(F.struct("gram", "anchor", "first", "last")).alias("runs"))
    )
    release(anchors, again)
    one_each = texts.join(by_text.withColumnRenamed("tid", "_tid"), F.col("tid") == F.col("_tid")).select(
        "tid", "text", "runs"
    )
    pieces = durable(_piece_rows(one_each, length))
    release(by_text)
    piece = ["gram", "digest"]
    # Rows of copies of a text are one: a piece is shared if two places of distinct texts have it.
    counts = durable(
        pieces.select(*piece, "tid", "first").distinct().groupBy(*piece).agg(F.count("*").alias("n"))
    )
    groups = durable(counts.groupBy("gram").agg(F.count("*").alias("pieces")).where("pieces > 1"))
    distinct = durable(
        pieces.where("piece is not null").join(groups, "gram")
        .groupBy(*piece, "pieces").agg(F.first("anchor").alias("anchor"), F.first("piece").alias("piece"))
    )
    usual = distinct.where(F.col("pieces") <= GROUP_PIECES).select("gram", "digest", "anchor", "piece")
    with batch_rows(spark, 4096):
        solved = durable(
            usual.repartition("gram").sortWithinPartitions("gram").mapInArrow(
                _sorted_pieces(length), "gram long, digest binary, shared array<int>"
            )
        )
        hot = distinct.where(F.col("pieces") > GROUP_PIECES)
        hot_solved = None if hot.isEmpty() else durable(_hot_windows(hot, length))
    release(groups, distinct)
    shared = solved if hot_solved is None else solved.unionByName(hot_solved)
    whole = counts.where("n > 1").select(*piece, F.lit(True).alias("whole"))
    marks = durable(shared.join(whole, piece, "full"))
    release(solved, hot_solved, counts)
    # Runs in the text: the whole run of windows, or the shared starts moved to the piece's place.
    spans = pieces.select(*piece, "tid", "first", "last").join(marks, piece).select(
        "tid",
        F.when(F.col("whole"), F.array("first", "last"))
        .otherwise(F.transform("shared", lambda s: s + F.col("first"))).alias("spans"),
    )
    result = durable(spans.groupBy("tid").agg(F.flatten(F.collect_set("spans")).alias("spans")))
    release(pieces, marks)
    return result


def _several(tid: str) -> Column:
    """Aggregate: are there different ones among the ``tid``? By 128 bits of each, in long buffers."""
    halves = [F.xxhash64(tid), F.xxhash64(F.lit(1), tid)]
    return (F.min(halves[0]) < F.max(halves[0])) | (F.min(halves[1]) < F.max(halves[1]))


def _hot_shared_pieces(pieces: DataFrame, n_words: int) -> DataFrame:
    """``gram`` and ``digest`` of pieces in groups too large for a task, whose windows others have as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, digest, owner, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = piece.split()
                found = [b" ".join(words[s : s + n_words]) for s in range(len(words) - n_words + 1)]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([gram] * n, pa.int64()), pa.array([digest] * n, pa.binary()),
                        # A piece without an owner is its own owner: no text's name is as long.
                        pa.array([owner or digest + digest] * n, pa.binary()),
                        pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in found], pa.binary()),
                    ],
                    ["gram", "digest", "owner", "window"],
                )

    windows = durable(
        pieces.select("gram", "digest", "owner", "piece")
        .mapInArrow(run, "gram long, digest binary, owner binary, window binary")
    )
    common = windows.groupBy("window").agg(_several("owner").alias("several")).where("several").select("window")
    found = durable(windows.join(common, "window", "left_semi").select("gram", "digest").distinct())
    release(windows)
    return found


def texts_with_shared_words(texts: DataFrame, n_words: int, gram: int = GRAM_WORDS) -> DataFrame:
    """``tid`` of texts that hold ``n_words`` words in a row which a text of another ``tid`` holds too.

    Words are runs of other bytes than ASCII white space; what stands between them does not count.
    ``texts`` has ``tid`` (of equal texts the same) and ``text``. Texts that occur more than once
    need not be found here: the caller knows them.
    """
    spark = texts.sparkSession
    gram = min(gram, n_words)
    anchors = durable(_anchor_rows(texts, n_words, gram, in_words=True))
    # Stored, so that the join is one of two shuffles, where Spark can split a common gram.
    again = durable(
        anchors.groupBy("gram").agg(_several("tid").alias("several")).where("several").select("gram")
    )
    by_text = durable(
        anchors.join(again, "gram", "left_semi")
        .groupBy("tid").agg(F.collect_set(F.struct("gram", "anchor", "first", "last")).alias("runs"))
    )
    release(anchors, again)
    one_each = texts.join(by_text.withColumnRenamed("tid", "_tid"), F.col("tid") == F.col("_tid")).select(
        "tid", "text", "runs"
    )
    pieces = durable(_piece_rows(one_each, n_words, in_words=True))
    release(by_text)
    piece = ["gram", "digest"]
    distinct = durable(
        pieces.groupBy(*piece).agg(
            _several("tid").alias("whole"), F.first("tid").alias("owner"),
            F.first("anchor").alias("anchor"), F.first("piece", True).alias("piece"),
        ).withColumn("owner", F.when(~F.col("whole"), F.col("owner")))
    )
    groups = durable(distinct.groupBy("gram").agg(F.count("*").alias("pieces")).where("pieces > 1"))
    usual = distinct.join(groups.where(F.col("pieces") <= GROUP_PIECES), "gram")
    with batch_rows(spark, 4096):
        solved = durable(
            usual.select("gram", "digest", "anchor", "piece", "owner")
            .repartition("gram").sortWithinPartitions("gram").mapInArrow(
                _sorted_pieces(n_words, in_words=True), "gram long, digest binary, shared array<int>"
            ).select(*piece)
        )
        hot = distinct.join(groups.where(F.col("pieces") > GROUP_PIECES), "gram")
        hot_solved = None if hot.isEmpty() else _hot_shared_pieces(hot, n_words)
    shared = distinct.where("whole").select(*piece).unionByName(solved)
    shared = shared if hot_solved is None else shared.unionByName(hot_solved)
    result = durable(pieces.join(shared, piece, "left_semi").select("tid").distinct())
    release(pieces, distinct, groups, solved, hot_solved)
    return result


def text_id(text: str = "text") -> Column:
    """Column: 128 bits of SHA-256 that name a text; null and empty texts are one."""
    return F.unhex(F.left(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), F.lit(32)))


def drop_passages(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: list[str] | None = None,
    n_words: int | None = None,
) -> DataFrame:
    """Columns ``keep`` (default: all), ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans``.

    Each byte of a whole text (as UTF-8) goes that a string of ``length`` bytes covers which also
    starts anywhere else, in the same text included; overlaps count, and strings are judged on the
    input. Null and empty texts have no bytes. Texts with copies lose all their bytes if they are
    long enough; rows that repeat are copies. What is kept is bytes, as a cut may part a character.

    With ``n_words``, a column ``shares_words`` says whether a text holds that many words in a row
    which another row's text holds too, however few bytes they have. It removes nothing.
    """
    columns = [c for c in (documents.columns if keep is None else keep)]
    named = documents.select(text_id().alias("tid"), "text")
    copies = durable(named.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid"))
    windows = repeated_windows(named.where(F.octet_length("text") >= length), length, gram)
    tid, own_spans, own_copied, own_shares = (
        unused(documents, c) for c in ("_tid", "_spans", "_copied", "_shares")
    )
    marked = windows.join(copies.withColumn("copied", F.lit(True)), "tid", "full")
    sharing = None
    if n_words is not None:
        # A word and what parts it from the next one are two bytes at least.
        sharing = texts_with_shared_words(named.where(F.octet_length("text") >= 2 * n_words - 1), n_words)
        marked = marked.join(sharing.withColumn("shares", F.lit(True)), "tid", "full")
    marks = durable(
        marked.select(
            F.col("tid").alias(tid), F.col("spans").alias(own_spans), F.col("copied").alias(own_copied),
            (F.lit(None).cast("boolean") if sharing is None else F.col("shares")).alias(own_shares),
        )
    )
    release(copies, windows, sharing)
    joined = documents.join(marks, text_id() == F.col(tid), "left")

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = []
            marked = zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True)
            for value, (flat, copied, shares) in zip(byte_texts(batch.column(0)), marked, strict=True):
                text = value or b""
                spans = sorted(zip(flat[::2], flat[1::2], strict=True)) if flat else []
                if copied and len(text) >= length:
                    spans = [(0, len(text) - length)]
                kept, end, count = [], 0, 0
                for first, last in spans:
                    if first > end or not count:
                        kept.append(text[end:first])
                        count += 1
                    end = max(end, last + length)
                kept.append(text[end:])
                rest = b"".join(kept)
                row = (rest, len(text), len(text) - len(rest), count)
                if n_words is not None:
                    row += (bool(shares or (copied and len(text.split()) >= n_words)),)
                rows.append(row)
            return {
                name: pa.array(values, _KEPT[name])
                for name, values in zip(list(_KEPT)[: len(rows[0])], zip(*rows, strict=True), strict=True)
            }

        return work

    added = "kept binary, n_bytes long, n_removed long, n_spans long"
    added += "" if n_words is None else ", shares_words boolean"
    return add_columns(joined, ["text", own_spans, own_copied, own_shares], added, make, columns)


_KEPT = {
    "kept": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
    "shares_words": pa.bool_(),
}
