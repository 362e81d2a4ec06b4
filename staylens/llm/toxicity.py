"""A convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of the hashed embeddings of the word and of its first letters, so
that a rare form of a known stem is known as well.

Trained in numpy on all labelled rows, a part of them in each task, and applied to whole texts inside
tasks. After each round the parts' weights are averaged in tasks, and the driver holds one set of them.
The score of a text depends on its words alone. Thresholds by language are calibrated on a fifth of the
rows that the training does not see; ``decided`` compares a score with them, which never depends on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from staylens.llm.frames import add_columns, ship
from staylens.llm.words import byte_texts, words
from staylens.sources.durable import durable, release

# Rows of the larger class and bytes of texts that one task learns from: more rows make more tasks.
PART_ROWS = 4800
PART_BYTES = 1 << 26
# Times that each row is learned from, at least, and the parts of each time after which weights are averaged.
EPOCHS = 3
SLICES = 2
# Rows of the rarer class that a part has at least, if there are as many; with fewer each round has them all.
RARE_ROWS = 320
# Weights that one task adds up.
FAN_IN = 16
# Share of the rows kept for calibration, and the fewest rows for a threshold of a language's own.
CALIBRATION_SHARE = 0.2
CALIBRATION_ROWS = 30
# Steps of the scores that thresholds are chosen from, to one of their log-odds.
STEPS_A_LOGIT = 64

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
# Bytes of the beginnings that are hashed beside the whole word.
BEGINNINGS = (4, 5, 6)
PARTS = 1 + len(BEGINNINGS)
# Words whose buckets a task remembers before it starts anew.
CACHE_ENTRIES = 300_000
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 16
# Steps of the training, at least: few rows are gone through more often.
STEPS = 900
# Embeddings start near zero: words that the training has not seen say nothing.
START = 0.02
EMBEDDING_RATE = 60.0
WORD_DROPOUT = 0.1
BATCH = 32
# Positions that one convolution step handles: bounds memory for any length of text.
BLOCK = 1 << 14


@dataclass
class TextCnn:
    """Weights; row 0 of the embedding is the padding between texts and stays zero."""

    embedding: np.ndarray
    kernels: list[np.ndarray]  # by width: (width, DIMENSIONS, FILTERS)
    biases: list[np.ndarray]
    output: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    @classmethod
    def start(cls, seed: int) -> TextCnn:
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, START, (BUCKETS, DIMENSIONS)).astype(np.float32)
        embedding[0] = 0
        return cls(
            embedding,
            [rng.normal(0, 0.3 / w**0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32),
            0.0,
        )

    def embed(self, packed: np.ndarray) -> np.ndarray:
        return sum(self.embedding[rows] for rows in _unpacked(packed))

    def pooled(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strongest response of each filter in each text, where it is, and the joined word ids.

        Texts are joined with padding between them, so that no window covers two texts.
        """
        pad = np.zeros(max(WIDTHS) - 1, np.int64)
        joined = np.concatenate([part for t in texts for part in (pad, t)] + [pad])
        # A text's windows are those that start in the padding before it or in its words.
        sizes = np.array([len(pad) + len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        total = int(sizes.sum())
        best = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64)
        for begin in range(0, total, BLOCK):
            end = min(total, begin + BLOCK)
            vectors = self.embed(joined[begin : end + len(pad)])
            first = int(np.searchsorted(starts, begin, "right")) - 1
            last = int(np.searchsorted(starts, end, "left"))
            cuts = np.maximum(starts[first:last], begin) - begin
            for k, width in enumerate(WIDTHS):
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                response = self.biases[k] + sum(
                    vectors[j : j + end - begin] @ self.kernels[k][j] for j in range(width)
                )
                peaks = np.maximum.reduceat(response, cuts, axis=0)
                better = peaks > best[first:last, columns]
                best[first:last, columns] = np.where(better, peaks, best[first:last, columns])
                if self._training:
                    ends = np.append(cuts[1:], end - begin)
                    found = np.stack([
                        begin + a + response[a:b].argmax(axis=0) for a, b in zip(cuts, ends, strict=True)
                    ])
                    where[first:last, columns] = np.where(better, found, where[first:last, columns])
        return best, where, joined

    _training = False

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        best, _, _ = self.pooled(texts)
        return np.maximum(best, 0).astype(np.float64) @ self.output.astype(np.float64) + self.offset

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Between 0 and 1; higher means that label 1 is likelier."""
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -40, 40)))

    def settle(self, share: float | None) -> None:
        """Without rows of both classes: one score for all texts, by the class there is."""
        self.output[:] = 0
        self.offset = -4.0 if share is None else 4.0 * (2 * share - 1)

    def fit(
        self, texts: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int,
        state: Training | None = None, done: tuple[float, float] = (0.0, 1.0),
    ) -> None:
        """Adam on balanced batches; the gradient flows through each filter's strongest window.

        Each epoch goes through all rows of the larger class, and through those of the other as often
        as it takes. ``done`` are the shares of the whole training before and after.
        """
        rng = np.random.default_rng(seed)
        classes = [c for c in (np.flatnonzero(labels == label) for label in (0, 1)) if len(c)]
        if not classes:
            return
        state = Training.start(self) if state is None else state
        each = BATCH // len(classes)
        steps = epochs * math.ceil(max(map(len, classes)) / each)
        orders = [_shuffled(c, each * steps, rng) for c in classes]
        self._training = True
        shared = [*self.kernels, *self.biases, self.output]
        for number in range(steps):
            state.steps += 1
            step, spread = state.steps, state.spread  # spread of the rows' gradients: rows move as far as they agree
            chosen = np.concatenate([order[number * each : (number + 1) * each] for order in orders])
            # Some words are left out each time, so that no single one decides alone.
            seen = [texts[i] * (rng.random(len(texts[i])) >= WORD_DROPOUT) for i in chosen]
            best, where, joined = self.pooled(seen)
            active = np.maximum(best, 0)
            logit = active @ self.output + self.offset
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[chosen]) / len(chosen)
            back = error[:, None] * self.output * (best > 0)
            rate = 0.02 * (1 - 0.9 * (done[0] + (done[1] - done[0]) * (number + 1) / steps))
            gradients, rows, row_gradients = [], [], []
            for k, width in enumerate(WIDTHS):
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                windows = where[:, columns, None] + np.arange(width)
                ids = joined[windows]  # text, filter, place in the window
                flow = back[:, columns]
                gradients.append(np.einsum("tf,tfjd->jdf", flow, self.embed(ids)))
                back_rows = np.einsum("tf,jdf->tfjd", flow, self.kernels[k]).reshape(-1, DIMENSIONS)
                for part in _unpacked(ids.ravel()):
                    rows.append(part)
                    row_gradients.append(back_rows)
            gradients += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            gradients.append(active.T @ error)
            for parameter, gradient, (m, v) in zip(shared, gradients, state.moments, strict=True):
                gradient = gradient + 1e-4 * parameter
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient**2 - v)
                parameter -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            self.offset -= float(5 * rate * error.sum())
            flat = np.concatenate(rows)
            order = np.argsort(flat, kind="stable")
            touched, firsts = np.unique(flat[order], return_index=True)
            total = np.add.reduceat(np.concatenate(row_gradients)[order], firsts, axis=0)
            total[touched == 0] = 0
            largest = float(np.sqrt((total**2).sum(axis=1).max()))
            state.spread = spread = max(largest, 0.95 * spread)
            self.embedding[touched] -= EMBEDDING_RATE * rate * total / (spread + 1e-9)
        self._training = False

    def calibrate(self, texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None]) -> None:
        """For all and for each language with enough rows, the threshold of the best F1."""
        scores = self.scores(texts) if texts else []
        order = np.argsort([-score for score in scores], kind="stable")
        steps = [Row(step=-at, lang=langs[i] or "", n=1, hits=int(labels[i]), low=float(scores[i]), high=float(scores[i]))
                 for at, i in enumerate(order)]
        by_lang: dict[str, list[Row]] = {}
        for row in steps:
            by_lang.setdefault(row.lang, []).append(row)
        self.choose(steps, by_lang)

    def choose(self, steps: list[Row], by_lang: dict[str, list[Row]]) -> None:
        """Thresholds from the numbers of rows and of label 1 at each step of the scores."""
        if not steps:
            return
        self.threshold = _best_threshold(steps)
        for lang, own in by_lang.items():
            n, hits = sum(r.n for r in own), sum(r.hits for r in own)
            if n >= CALIBRATION_ROWS and 0 < hits < n:
                self.thresholds[lang] = _best_threshold(own)


@dataclass
class Training:
    """What Adam remembers from step to step."""

    moments: list[tuple[np.ndarray, np.ndarray]]
    spread: float = 0.0
    steps: int = 0

    @classmethod
    def start(cls, model: TextCnn) -> Training:
        return cls([(np.zeros_like(p), np.zeros_like(p)) for p in [*model.kernels, *model.biases, model.output]])


def _shuffled(rows: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """The rows in random order, all of them before any comes again."""
    return np.concatenate([rng.permutation(rows) for _ in range(math.ceil(size / len(rows)))])[:size]


def _best_threshold(steps: list[Row]) -> float:
    """Middle of the gap in the scores whose upper side has the best F1."""
    steps = sorted(steps, key=lambda row: -row.step)
    hits = np.cumsum([row.hits for row in steps])
    if not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.cumsum([row.n for row in steps]) + hits[-1])
    k = int(f1.argmax())
    below = steps[k + 1].high if k + 1 < len(steps) else 0.0
    return (steps[k].low + below) / 2


class _Buckets(dict):
    """Packed buckets by word, bounded."""

    def __missing__(self, word: bytes) -> int:
        packed = crc32(word) % (BUCKETS - 1) + 1
        for part, size in enumerate(BEGINNINGS, 1):
            packed |= (crc32(word[:size], size) % (BUCKETS - 1) + 1) << (part * BUCKET_BITS)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = packed
        return packed


def word_ids(text: bytes | None, buckets: _Buckets | None = None) -> np.ndarray:
    """Each word of the whole text as the buckets of its parts, packed into one number."""
    known = _Buckets() if buckets is None else buckets
    return np.array(list(map(known.__getitem__, words(text or b""))), np.int64)


def _unpacked(packed: np.ndarray) -> list[np.ndarray]:
    return [(packed >> (part * BUCKET_BITS)) & (BUCKETS - 1) for part in range(PARTS)]


@dataclass
class Sample:
    """Texts, labels and languages at hand, and the share of label 1 among all rows they stand for."""

    rows: list[tuple[bytes, int, str | None]]
    toxic_share: float = 0.5


def _epochs(rows: int) -> int:
    """Times to go through that many rows of the larger class."""
    return max(EPOCHS, math.ceil(STEPS * (BATCH // 2) / max(1, rows)))


def _prior(model: TextCnn, share: float) -> None:
    """The batches are balanced, so the offset is moved to the share of label 1."""
    if 0 < share < 1:
        model.offset += float(np.log(share / (1 - share)))


def train(drawn: Sample, seed: int = 17) -> TextCnn:
    """Fits the classifier on the rows given and calibrates its thresholds on the part held back."""
    sample = drawn.rows
    model = TextCnn.start(seed)
    buckets = _Buckets()
    texts = [word_ids(text, buckets) for text, _, _ in sample]
    labels = np.array([label for _, label, _ in sample], np.int64)
    every = round(1 / CALIBRATION_SHARE)
    # Every fifth row of each class in the given order, if there are enough of them.
    held = np.zeros(len(sample), bool)
    for label in (0, 1):
        rows = np.flatnonzero(labels == label)
        if len(rows) >= 5 * every:
            held[rows[::every]] = True
    fitted = np.flatnonzero(~held)
    sizes = np.bincount(labels[fitted], minlength=2)
    if min(sizes):
        model.fit([texts[i] for i in fitted], labels[fitted], _epochs(max(sizes)), seed)
    else:
        model.settle(float(np.mean(labels)) if len(labels) else None)
    _prior(model, drawn.toxic_share)
    kept = np.flatnonzero(held)
    model.calibrate([texts[i] for i in kept], labels[kept], [sample[i][2] for i in kept])
    return model


def train_on(documents: DataFrame, labels: DataFrame, seed: int = 17) -> TextCnn:
    """Fits the classifier on every labelled row and calibrates its thresholds on the part held back.

    ``labels`` has ``doc_id`` and ``toxic`` of the rows that may be learned from; rows without an id or a
    label of 0 or 1 are none. Whole texts are learned from, a null one as an empty one. Rows are dealt to
    tasks by hash, those of a rare class to several, so that no task lacks it; a task's rows and bytes
    are bounded, so more rows make more tasks. Texts stay on the executors.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")
    ).distinct()
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    place = F.xxhash64("doc_id", "text")
    # In a table, as the numbers of rows are needed before the rows are dealt. Labels grow with the texts.
    rows = durable(texts.join(known.hint("merge"), "doc_id").select("text", "lang", "toxic", place.alias("place")))
    every = round(1 / CALIBRATION_SHARE)
    held = F.pmod("place", F.lit(every)) == 0
    counts = {
        r.toxic: r for r in rows.groupBy("toxic").agg(
            F.count("*").alias("n"), F.count_if(held).alias("held"),
            F.sum(F.octet_length("text")).alias("bytes"),
        ).collect()
    }
    kept = [label for label, r in counts.items() if r.n >= 5 * every]
    held = held & F.col("toxic").isin(kept)
    sizes = {label: r.n - (r.held if label in kept else 0) for label, r in counts.items()}
    model = TextCnn.start(seed)
    if len(sizes) == 2 and min(sizes.values()):
        _fit_in_rounds(model, rows.where(~held), sizes, {label: int(r.bytes) for label, r in counts.items()}, seed)
    else:
        n = sum(r.n for r in counts.values())
        model.settle(sum(r.n for label, r in counts.items() if label) / n if n else None)
    share = known.agg(F.avg("toxic")).first()[0]
    _prior(model, 0.5 if share is None else share)
    _calibrate_on(model, rows.where(held))
    release(rows)
    return model


def _fit_in_rounds(model: TextCnn, rows: DataFrame, sizes: dict[int, int], size_bytes: dict[int, int], seed: int) -> None:
    """Each round every part goes on from the same weights with its own rows; then these are averaged.

    Rows that fit one part need no averaging and are one round.
    """
    rare, common = sorted((0, 1), key=lambda label: sizes[label])
    times = math.ceil(sizes[common] / sizes[rare])
    dealt_bytes = size_bytes[common] + size_bytes[rare] * times
    parts = max(math.ceil(sizes[common] / PART_ROWS), math.ceil(dealt_bytes / (2 * PART_BYTES)), 1)
    times = min(times, parts, math.ceil(RARE_ROWS * parts / sizes[rare]))
    copies = F.sequence(F.lit(0), F.when(F.col("toxic") == rare, times - 1).otherwise(0))
    # Copies of a row go to different parts.
    part = F.pmod(F.shiftright("place", 8) % parts + F.col("copy"), F.lit(parts)).cast("int")
    dealt = (
        rows.withColumn("copy", F.explode(copies)).repartitionById(parts, part)
        .sortWithinPartitions("place", "copy", "toxic").select("text", "toxic", "place")
        .persist(StorageLevel.DISK_ONLY)
    )
    epochs = _epochs(sizes[common])
    slices = SLICES if parts > 1 and sizes[rare] * times / parts >= RARE_ROWS else 1
    rounds = 1 if parts == 1 else epochs * slices
    state = Training.start(model)
    for number in range(rounds):
        done = (number / rounds, (number + 1) / rounds)
        own = dealt.where(F.pmod(F.shiftright("place", 40), F.lit(slices)) == number % slices)
        learned = _learned(own, model, state, epochs if parts == 1 else 1, seed + number, done)
        total = _added_up(learned, parts)
        if total is not None:
            _take_average(model, state, total)
    dealt.unpersist()


_SUM = "part int, total binary"


def _learned(
    rows: DataFrame, model: TextCnn, state: Training, epochs: int, seed: int, done: tuple[float, float]
) -> DataFrame:
    """For each part, its weights and how far it moved each embedding, to be added up."""
    shared = ship(rows.sparkSession, (model, state))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        buckets = _Buckets()
        texts: list[np.ndarray] = []
        labels: list[int] = []
        for batch in batches:
            texts += [word_ids(t, buckets) for t in byte_texts(batch.column("text"))]
            labels += batch.column("toxic").to_pylist()
        if not texts:
            return
        start, before = shared()
        own, after = deepcopy(start), deepcopy(before)
        own.fit(texts, np.array(labels, np.int64), epochs, seed * 1_000_003 + part, after, done)
        moved = own.embedding - start.embedding
        total = np.concatenate(
            [[len(texts)], len(texts) * _dense(own, after), moved.ravel(), moved.any(axis=1)]
        ).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         ["part", "total"])

    return rows.select("text", "toxic").mapInArrow(learn, _SUM)


def _added_up(learned: DataFrame, parts: int) -> np.ndarray | None:
    """Sum over all parts, made in tasks, in the parts' order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("total"):
                own = np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())],
                ["part", "total"],
            )

    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        group = F.floor(F.col("part") / FAN_IN).cast("int")
        learned = learned.repartitionById(parts, group).sortWithinPartitions("part").mapInArrow(add, _SUM)
    found = learned.collect()
    return np.frombuffer(found[0].total, np.float32).astype(np.float64) if found else None


def _dense(model: TextCnn, state: Training) -> np.ndarray:
    """All weights but the embeddings, and the state of the training."""
    arrays = [*model.kernels, *model.biases, model.output, *(a for pair in state.moments for a in pair)]
    return np.concatenate([*(a.ravel().astype(np.float64) for a in arrays), [model.offset, state.spread, state.steps]])


def _take_average(model: TextCnn, state: Training, total: np.ndarray) -> None:
    """Weights as the mean over rows; an embedding moves by the mean of the parts that moved it."""
    size = len(_dense(model, state))
    dense, moved, touched = total[1 : 1 + size] / total[0], total[1 + size : -BUCKETS], total[-BUCKETS:]
    at = 0
    for array in [*model.kernels, *model.biases, model.output, *(a for pair in state.moments for a in pair)]:
        array[...] = dense[at : at + array.size].reshape(array.shape)
        at += array.size
    model.offset, state.spread, state.steps = float(dense[-3]), float(dense[-2]), round(dense[-1])
    model.embedding += (moved.reshape(BUCKETS, DIMENSIONS) / np.maximum(touched, 1)[:, None]).astype(np.float32)


def _calibrate_on(model: TextCnn, rows: DataFrame) -> None:
    """Thresholds from all rows: the driver gets their numbers at each step of the scores."""
    scored = score_texts(rows, model, keep=["lang", "toxic"])
    below_one = F.least("score", F.lit(1 - 1e-15))
    step = F.floor(F.log(below_one / (1 - below_one)) * STEPS_A_LOGIT).alias("step")
    numbers = [F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high")]
    steps = durable(
        scored.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), step).agg(
            F.count("*").alias("n"), F.sum("toxic").alias("hits"), F.min("score").alias("low"), F.max("score").alias("high")
        )
    )
    large = steps.groupBy("lang").agg(F.sum("n").alias("rows")).where(F.col("rows") >= CALIBRATION_ROWS)
    by_lang: dict[str, list[Row]] = {}
    for row in steps.join(large, "lang").collect():
        by_lang.setdefault(row.lang, []).append(row)
    model.choose(steps.groupBy("step").agg(*numbers).collect(), by_lang)
    release(steps)


def score_texts(
    frame: DataFrame, model: TextCnn, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Columns ``keep`` (default: all) and ``score``, one row for each row.

    The score reads the whole text and nothing else. Null and empty texts get the score of a text
    without words. The model is broadcast: 1.6 MB whatever the data.
    """
    shared = ship(frame.sparkSession, model)

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        buckets = _Buckets()

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = [word_ids(t, buckets) for t in byte_texts(batch.column(0))]
            return {"score": pa.array(shared().scores(texts), pa.float64())}

        return work

    return add_columns(frame, [text], "score double", make, keep)


def decided(model: TextCnn, score: str = "score", lang: str = "lang"):
    """Column: 1 where the score reaches the threshold of the row's language, else 0."""
    return (F.col(score) >= language_threshold(model, lang)).cast("int")


def language_threshold(model: TextCnn, lang: str = "lang"):
    """Column: the calibrated threshold of the row's language, else the one for all."""
    column = F.lit(model.threshold)
    for name, threshold in sorted(model.thresholds.items()):
        column = F.when(F.col(lang) == name, F.lit(threshold)).otherwise(column)
    return column
