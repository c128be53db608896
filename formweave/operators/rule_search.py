"""The first rule of each label where the rules are few: numpy and strings, run inside tasks.

Entries (phrase, whole, word, key) come in the order of their rules.  An entry
is looked for under one window of its phrase (`containment`), the one the
fewest entries have; what has the window is tested in order up to the first
that fits, so a label costs its length and few tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from formweave.operators.containment import BITS, WORDS, _numbers, _stretches

_LOW = np.uint64((1 << BITS) - 1)


class Entries:
    """Entries by the window they are kept under."""

    def __init__(self, entries: list[dict]) -> None:
        self.phrases, self.whole = [x["phrase"] for x in entries], [x["whole"] for x in entries]
        self.words, self.keys = [x["word"] for x in entries], pa.array([x["key"] for x in entries], pa.string())
        all_windows = [np.zeros(0, np.uint64)]
        for first, offsets, data, groups in _stretches(_batch(pa.array(self.phrases, pa.string())), "text"):
            found = np.unique(_numbers(offsets, data, groups, True))
            all_windows.append(((found >> np.uint64(BITS)) + np.uint64(first) << np.uint64(BITS)) | (found & _LOW))
        found = np.concatenate(all_windows)
        owner, window = (found >> np.uint64(BITS)).astype(np.int64), found & _LOW
        _, same, counts = np.unique(window, return_inverse=True, return_counts=True)
        order = np.lexsort((window, counts[same], owner))
        owner, window = owner[order], window[order]
        kept = np.ones(len(owner), bool)
        kept[1:] = owner[1:] != owner[:-1]
        order = np.lexsort((owner[kept], window[kept]))
        self.windows, self.places = window[kept][order], owner[kept][order]
        self.used = np.zeros(WORDS, np.uint64)
        at = self.windows & np.uint64(64 * WORDS - 1)
        np.bitwise_or.at(self.used, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    def first(self, texts: pa.Array, sections: pa.Array) -> pa.Array:
        """The key of the first entry that fits each text under its section, null where none does."""
        place: list[int | None] = [None] * len(texts)
        text_of, section_of = texts.to_pylist(), sections.to_pylist()
        for first, offsets, data, groups in _stretches(_batch(texts), "text"):
            found = np.unique(_numbers(offsets, data, groups, False, self.used))
            window = found & _LOW
            low, high = np.searchsorted(self.windows, window, "left"), np.searchsorted(self.windows, window, "right")
            n = high - low
            text = np.repeat((found >> np.uint64(BITS)).astype(np.int64) + first, n)
            entry = self.places[np.arange(len(text)) + np.repeat(low - np.cumsum(n) + n, n)]
            order = np.lexsort((entry, text))
            done = -1
            for i, k in zip(text[order].tolist(), entry[order].tolist(), strict=True):
                if i != done and self._fits(k, text_of[i], section_of[i]):
                    place[i], done = k, i
        return self.keys.take(pa.array(place, pa.int64()))

    def _fits(self, k: int, text: str, section: str | None) -> bool:
        phrase, word = self.phrases[k], self.words[k]
        return (phrase == text if self.whole[k] else phrase in text) and (word is None or (section is not None and word in section))


def _batch(texts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([texts, pa.array(np.zeros(len(texts), np.int64))], names=["text", "g"])


def first_keys(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Keys for batches of (text, section, entries), the entries beside a task's first row."""
    known = None
    for texts, sections, entries in batches:
        if known is None and len(entries):
            known = Entries(entries[0].as_py())
        yield known.first(texts, sections) if known else pa.nulls(len(texts), pa.string())
