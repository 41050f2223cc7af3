"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
#: texts are handled in slices of about this many bytes, so what a task holds does not grow with a batch
SLICE = 1 << 20


def text_list(column: pa.Array) -> list[str]:
    """Texts of a string column; null is the empty text."""
    return pc.fill_null(column, "").to_pylist()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is the empty text."""
    flat = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = flat.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row stands alone."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of so many rows, so that only a part is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def worker_cache() -> dict:
    """State that lasts as long as a worker process. Functions travel by value, so their modules' own state is new in every task."""
    return sys.modules.setdefault("_playbill_worker", types.ModuleType("_playbill_worker")).__dict__


def hex_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def run_groups(batches: Iterator[pa.RecordBatch], keys: list[str], small: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal keys, and the lengths of the runs: neighbours of up to ``small`` rows together, a longer run alone.

    Runs go over batch borders. A run must be of bounded size.
    """
    held: list[pa.RecordBatch] = []
    last = None
    whole = lambda: (table := pa.Table.from_batches(held), np.array([table.num_rows]))
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        at, end = 0, len(cuts) - 2  # the last run stays open
        if held and tuple(c[0] for c in columns) == last:
            held.append(batch.slice(0, int(cuts[1])))
            at = 1
        if held and at <= end:
            yield whole()
            held = []
        sizes = np.diff(cuts)
        for long in [*(np.flatnonzero(sizes[at:end] > small) + at).tolist(), end]:
            for a, b in ((at, long), (long, min(long + 1, end))):
                if a < b:
                    yield pa.Table.from_batches([batch.slice(int(cuts[a]), int(cuts[b] - cuts[a]))]), sizes[a:b]
            at = max(at, long + 1)
        if not held:
            held = [batch.slice(int(cuts[end]))]
        last = tuple(c[-1] for c in columns)
    if held:
        yield whole()
