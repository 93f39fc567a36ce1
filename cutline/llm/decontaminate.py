"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased and reduced to words with one space between them. An item
is looked for in windows of ``WINDOW`` bytes, one from every ``STEP`` bytes of it (a shorter item is one
window), so a copied excerpt of ``WINDOW + STEP`` bytes holds a whole window wherever it was cut. A
copy of a window with at most k edits shares at least ``w - q + 1 - k q`` q-grams with it, all within
k diagonals, so shared q-grams are counted in overlapping bands of diagonals and a window that reaches
the bound is verified by banded alignment. k is ``BUDGET`` of the window. An item below ``LEAST`` bytes
has no bound that tells a copy from chance; it matches as a whole word sequence only.

The benchmark is a stated query set: its index is built in blocks of at most ``BLOCK_BYTES`` of item
text, and all texts meet one block after another. No text is cut: one long text is one pass, and its
shared q-grams are met ``PAIRS`` at a time, in stretches that overlap by more than a window.

Defined results: null or empty texts and items match nothing; items with equal text are each
reported; a repeated row is reported and judged by its own text, also where its id is null. Other
columns pass through ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm import kernels

Q = 10
WINDOW = 72
STEP = 8
BUDGET = 0.08
#: Items below this many bytes match as a whole word sequence.
LEAST = 40
#: Shared q-grams of one text that are held at once (more where one place alone has more).
PAIRS = 1 << 20
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 22
_SCALE = np.uint64(0x9E3779B97F4A7C15)
_SCALE_2 = np.uint64(0xC2B2AE3D27D4EB4F)
_PLAIN = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(_PLAIN).split())


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of the Q bytes from every position; the last Q - 1 positions have none."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    return words[:n] * _SCALE ^ words[Q - 8 : Q - 8 + n] * _SCALE_2


class Index:
    """The q-grams of a block of items, with the windows to be looked for."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.texts, self.starts, self.least, codes, owners, places = [], [], [], [], [], [], []
        short: dict[bytes, list[int]] = {}
        for item, text in items:
            raw = plain(text)
            if not raw:
                continue
            if len(raw) < LEAST:
                short.setdefault(b" " + raw + b" ", []).append(len(self.ids))
            else:
                code = grams(np.frombuffer(raw, np.uint8))
                codes.append(code)
                owners.append(np.full(len(code), len(self.ids)))
                places.append(np.arange(len(code)))
            size = min(len(raw), WINDOW)
            self.ids.append(item)
            self.texts.append(raw)
            self.starts.append(np.unique(np.append(np.arange(0, len(raw) - size, STEP), len(raw) - size)))
            self.least.append(max(1, size - Q + 1 - int(BUDGET * size) * Q))
        self.least = np.array(self.least, np.int64)
        self.words = ahocorasick.Automaton()
        for raw, own in short.items():
            self.words.add_word(raw.decode("latin-1"), (len(raw), own))
        if short:
            self.words.make_automaton()
        self.codes = np.zeros(0, np.uint64)
        if not codes:
            return
        code, owner, place = map(np.concatenate, (codes, owners, places))
        order = np.argsort(code, kind="stable")
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.owner, self.place = owner[order], place[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.codes >> np.uint64(64 - _TABLE_BITS)] = True

    def _whole(self, raw: bytes) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Short items that stand in ``raw`` as whole words; their first place."""
        hits: dict[tuple[int, int], tuple[int, int, int]] = {}
        if len(self.words):
            for end, (size, own) in self.words.iter(f" {raw.decode('latin-1')} "):
                for item in own:
                    hits.setdefault((item, 0), (end + 1 - size, end - 1, 0))
        return hits

    def _stretches(self, at: np.ndarray, times: np.ndarray) -> Iterator[slice]:
        """Slices of the shared places with about ``PAIRS`` pairs; each window's copy lies whole in one."""
        overlap = WINDOW + 2 * int(BUDGET * WINDOW) + Q
        total = np.cumsum(times)
        start = 0
        while start < len(at):
            before = total[start - 1] if start else 0
            end = max(int(np.searchsorted(total, before + PAIRS, "right")), start + 1)
            # Never shorter than two overlaps, so that each slice goes on past the one before.
            end = max(end, int(np.searchsorted(at, at[start] + 2 * overlap, "right")))
            yield slice(start, end)
            if end >= len(at):
                return
            start = int(np.searchsorted(at, at[end] - overlap))

    def search(self, raw: bytes) -> list[tuple[int, int, int, int, int]]:
        """(item number, start, end, edits, windows found) of each item in one text."""
        hits = self._whole(raw)
        code = grams(np.frombuffer(raw, np.uint8))
        if len(self.codes) and len(code):
            at = np.flatnonzero(self.table[code >> np.uint64(64 - _TABLE_BITS)])
            spot = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
            true = self.codes[spot] == code[at]
            at, spot = at[true], spot[true]
            for part in self._stretches(at, self.count[spot]):
                self._meet(raw, at[part], spot[part], hits)
        best: dict[int, list] = {}
        for (item, _), (start, end, edits) in hits.items():
            x = best.setdefault(item, [start, end, edits, 0])
            x[:] = [min(x[0], start), max(x[1], end), max(x[2], edits), x[3] + 1]
        return [(item, *x) for item, x in sorted(best.items())]

    def _meet(self, raw: bytes, at: np.ndarray, spot: np.ndarray, hits: dict) -> None:
        """Add the windows found among the q-grams shared at places ``at`` to ``hits``."""
        times = self.count[spot]
        pos = np.repeat(at, times)
        row = np.repeat(self.first[spot] - np.cumsum(times) + times, times) + np.arange(len(pos))
        owner, place = self.owner[row], self.place[row]
        # Bands are numbered from 0 for each item: no diagonal is below minus the longest item.
        diagonal = pos - place + int(self.place.max()) + 1
        width = 2 * int(BUDGET * WINDOW) + 2
        for shift in (0, width // 2):
            band = owner * (1 << 40) + (diagonal + shift) // width
            order = np.argsort(band, kind="stable")
            cuts = np.flatnonzero(np.diff(band[order], prepend=-1))
            sizes = np.diff(np.append(cuts, len(order)))
            enough = sizes >= self.least[owner[order[cuts]]]
            for a, n in zip(cuts[enough], sizes[enough]):
                members = order[a : a + n]
                item = int(owner[members[0]])
                self._verify(raw, item, pos[members], place[members], hits)

    def _verify(self, raw: bytes, item: int, pos: np.ndarray, place: np.ndarray, hits: dict) -> None:
        text, starts = self.texts[item], self.starts[item]
        size = min(len(text), WINDOW)
        by = np.argsort(place, kind="stable")
        pos, place = pos[by], place[by]
        seen = np.unique(place)
        met = np.searchsorted(seen, starts + size - Q, "right") - np.searchsorted(seen, starts)
        edits = int(BUDGET * size)
        for s in starts[met >= self.least[item]].tolist():
            if (item, s) in hits:
                continue
            inside = slice(np.searchsorted(place, s), np.searchsorted(place, s + size - Q, "right"))
            # One band holds copies at far-apart places of a repetitive text: each is aligned on its own.
            where = np.unique(pos[inside] - (place[inside] - s))
            for group in np.split(where, np.flatnonzero(np.diff(where) > size) + 1):
                found = align(text[s : s + size], raw, int(group[0]), int(group[-1]) + size, edits)
                if found:
                    hits[item, s] = found
                    break


def align(window: bytes, raw: bytes, low: int, high: int, edits: int):
    """(start, end, edits) of a copy of ``window`` near raw[low:high] with at most ``edits``, or None."""
    low, high = max(0, low - edits), min(len(raw), high + edits)
    exact = raw.find(window, low, high)
    if exact >= 0:
        return exact, exact + len(window), 0
    text = np.frombuffer(raw[low:high], np.uint8)
    # Columns are places of the text; a copy may begin at any of them.
    cost, start = np.zeros(len(text) + 1, np.int32), np.arange(len(text) + 1)
    for i, byte in enumerate(window):
        step = cost[:-1] + (text != byte)
        skip = cost[1:] + 1
        new, origin = np.empty_like(cost), np.empty_like(start)
        new[0], origin[0] = i + 1, start[0]
        new[1:] = np.minimum(step, skip)
        origin[1:] = np.where(step <= skip, start[:-1], start[1:])
        # Text bytes left over: each costs one, carried along the row.
        ramp = new - np.arange(len(new))
        least = np.minimum.accumulate(ramp)
        source = np.maximum.accumulate(np.where(ramp == least, np.arange(len(new)), 0))
        cost, start = least + np.arange(len(new)), origin[source]
        if cost.min() > edits:
            return None
    end = int(cost.argmin())
    return (low + int(start[end]), low + end, int(cost[end])) if cost[end] <= edits else None


def _own(index) -> Index:
    """The index of a broadcast: its parts travel as plain values, the class with the function."""
    own = Index.__new__(Index)
    own.__dict__.update(index.value)
    return own


def _searching(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(index)
        for batch in batches:
            rows, out = [], []
            for at, text in enumerate(batch.column(1)):
                for found in own.search(plain(text.as_py())):
                    rows.append(at)
                    out.append((own.ids[found[0]], *found[1:]))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", "item_id", "start", "end", "edits", "windows"],
            )

    return run


def _clean(index, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(index)
        for batch in batches:
            yield batch.filter(pa.array([not own.search(plain(t.as_py())) for t in batch.column(text)], pa.bool_()))

    return run


SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint, windows bigint"


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast indexes of the benchmark, a block of at most ``BLOCK_BYTES`` each; one at least."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    block, size = [], 0
    for item, text in items.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(text) > BLOCK_BYTES:
            yield docs.sparkSession.sparkContext.broadcast(vars(Index(block)))
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield docs.sparkSession.sparkContext.broadcast(vars(Index(block)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` and benchmark item found in it, with its place in the plain text.

    ``start`` and ``end`` are bytes of the lower-cased text with single spaces between words;
    ``edits`` is the most of any window found and ``windows`` how many were.
    """
    texts = docs.select("doc_id", "text")
    found = [texts.mapInArrow(_searching(index), SCHEMA) for index in _indexes(docs, benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a passage of the benchmark."""
    for index in _indexes(docs, benchmark):
        docs = docs.mapInArrow(_clean(index, docs.columns.index("text")), docs.schema)
    return docs
