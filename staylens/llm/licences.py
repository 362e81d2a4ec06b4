"""Licence notices in texts, by a generalised suffix automaton of notice words.

The automaton holds every run of words of every notice. Streaming a text through it gives, at each
word, the longest run ending there that occurs in some notice (the matching statistics). Runs that
cannot grow at a place of a notice are matches there; long matches that follow each other in one notice are chained, and a chain
that covers enough of the notice names its licence. Short names are in the automaton too, but in no chain:
one ends wherever the state, or a state that its suffix links reach, stands for the name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from staylens.llm.frames import add_columns, ship
from staylens.llm.words import byte_texts, words

# Words of a match that may enter a chain, and words of text or notice between two matches.
MIN_MATCH = 3
MAX_GAP = 12
# Share of a notice that a chain must cover to name its licence.
MIN_COVER = 0.6


@dataclass
class Chain:
    """Matches in one notice that follow each other: where they end, and what they cover."""

    text_start: int
    text_end: int
    notice_end: int
    covered: int


class NoticeAutomaton:
    """Suffix automaton of several sequences of words; its size is that of the notices."""

    def __init__(self, names: dict[str, str], notices: dict[str, str | tuple[str, ...]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        # For each state, all places (notice, end) where its runs end.
        self.places: list[set[tuple[int, int]]] = [set()]
        self.labels: list[str] = []
        self.sizes: list[int] = []
        for text in names.values():
            # No places: names count by their exact endings only and enter no chain.
            state = 0
            for word in words(text.encode()):
                state = self._extend(state, self.ids.setdefault(word, len(self.ids)))
        every = [(label, text) for label, own in notices.items() for text in ((own,) if isinstance(own, str) else own)]
        for label, text in every:
            found = words(text.encode())
            state = 0
            for place, word in enumerate(found):
                state = self._extend(state, self.ids.setdefault(word, len(self.ids)))
                self.places[state].add((len(self.labels), place + 1))
            self.labels.append(label)
            self.sizes.append(len(found))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]
        # For each state, every place where a run of MIN_MATCH words of it ends, and the words it may have.
        self.ends: list[dict[tuple[int, int], int]] = [{} for _ in self.length]
        for state in order:
            if self.length[state] >= MIN_MATCH:
                self.ends[state] = self.ends[self.link[state]] | dict.fromkeys(self.places[state], self.length[state])
        # Names that end where a state is reached, each with the words the match needs.
        self.ending: list[tuple[tuple[int, str], ...]] = [()] * len(self.length)
        own: dict[int, list[tuple[int, str]]] = {}
        for label, text in names.items():
            found = words(text.encode())
            own.setdefault(self._state_of(found), []).append((len(found), label))
        for state in order:
            self.ending[state] = self.ending[self.link[state]] + tuple(own.get(state, ()))

    def _state_of(self, found: list[bytes]) -> int:
        state = 0
        for word in found:
            state = self.next[state][self.ids[word]]
        return state

    def _extend(self, last: int, word: int) -> int:
        """The state of the sequence so far and one more word."""
        if word in self.next[last]:
            there = self.next[last][word]
            if self.length[there] == self.length[last] + 1:
                return there
            return self._split(last, there, word)
        new = self._state(self.length[last] + 1, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state < 0:
            self.link[new] = 0
            return new
        there = self.next[state][word]
        if self.length[there] == self.length[state] + 1:
            self.link[new] = there
        else:
            self.link[new] = self._split(state, there, word)
        return new

    def _split(self, state: int, there: int, word: int) -> int:
        """Parts the shorter runs of a state from its longer ones."""
        copy = self._state(self.length[state] + 1, dict(self.next[there]))
        self.link[copy] = self.link[there]
        self.link[there] = copy
        while state >= 0 and self.next[state].get(word) == there:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        self.places.append(set())
        return len(self.next) - 1

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float], float]:
        """Places of names (start, label), covered share by notice label, and the best share."""
        follow, link, length, ending = self.next, self.link, self.length, self.ending
        known = list(map(self.ids.get, text))
        names: list[tuple[int, str]] = []
        chains: dict[int, list[Chain]] = {}
        cover: dict[str, float] = {}
        state = size = 0
        # Matches that the words so far end: their places in notices, and their words.
        open_matches: dict[tuple[int, int], int] = {}
        for place, word in enumerate([*known, None]):
            before = size
            if word is None:
                state = size = 0
            else:
                step = follow[state].get(word)
                while step is None and state:
                    state = link[state]
                    size = length[state]
                    step = follow[state].get(word)
                state, size = (0, 0) if step is None else (step, size + 1)
            going_on = {}
            if size >= MIN_MATCH:
                going_on = {at: min(n_words, size) for at, n_words in self.ends[state].items()}
            for (notice, end), n_words in open_matches.items():
                if (notice, end + 1) not in going_on:
                    self._chain(chains, cover, notice, end, place, n_words, place - before)
            open_matches = going_on
            for needed, label in ending[state]:
                if needed <= size:
                    names.append((place + 1 - needed, label))
        shares = {label: share for label, share in cover.items() if share >= MIN_COVER}
        return names, shares, min(1.0, max([*cover.values(), 1.0 if names else 0.0]))

    def _chain(self, chains: dict[int, list[Chain]], cover: dict[str, float],
               notice: int, notice_end: int, text_end: int, size: int, longest_start: int) -> None:
        """Adds the match of ``size`` words before ``text_end`` to the chains of its notice.

        No match to come starts before ``longest_start``.
        """
        best = Chain(text_end - size, text_end, notice_end, size)
        near = []
        for chain in chains.get(notice, ()):
            if chain.text_end + MAX_GAP < longest_start:
                continue  # nothing to come is near it
            near.append(chain)
            # New words are those that overlap neither the chain's text nor its notice part.
            new = min(size, text_end - chain.text_end, notice_end - chain.notice_end)
            gap = max(text_end - chain.text_end, notice_end - chain.notice_end) - new
            if 0 < new and gap <= MAX_GAP and chain.covered + new > best.covered:
                best = Chain(chain.text_start, text_end, notice_end, chain.covered + new)
        # Of chains with the same end in the notice, the one that covers most will do.
        near = [c for c in near if c.notice_end != notice_end or c.covered > best.covered]
        chains[notice] = [*near, best]
        label, share = self.labels[notice], best.covered / self.sizes[notice]
        if share > cover.get(label, 0.0):
            cover[label] = share


def scan_licences(
    frame: DataFrame,
    names: dict[str, str],
    notices: dict[str, str | tuple[str, ...]],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (default: all) and what each whole text holds.

    ``n_words``; ``n_base``, ``first_word``, ``last_word``: number, smallest and largest start (in
    words) of names; ``base_labels`` and ``labels``: labels of names, and of names and covered
    notices, distinct, sorted, comma-joined (a label may have several notices, such as a header and the
    whole licence); ``score``: the best covered share of a notice, 1 where
    a name stands. Null and empty texts have no words, empty labels and score 0. The automaton is
    broadcast: its size is that of the notices, whatever the data. No shuffle.
    """
    shared = ship(frame.sparkSession, NoticeAutomaton(names, notices))

    def make() -> Callable[[pa.RecordBatch], dict[str, pa.Array]]:
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            automaton = shared()
            rows = []
            for value in byte_texts(batch.column(0)):
                text_words = words(value or b"")
                found, shares, score = automaton.scan(text_words)
                base = {label for _, label in found}
                starts = [place for place, _ in found]
                rows.append((
                    len(text_words), len(found), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base.union(shares))), score,
                ))
            columns = zip(*rows, strict=True)
            return {
                name: pa.array(values, kind)
                for (name, kind), values in zip(_COLUMNS.items(), columns, strict=True)
            }

        return work

    added = (
        "n_words long, n_base long, first_word long, last_word long,"
        " base_labels string, labels string, score double"
    )
    return add_columns(frame, [text], added, make, keep)


_COLUMNS = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
}
