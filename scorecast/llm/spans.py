"""Whole-batch text scanning inside a task: code points, token runs and span hashes.

Texts of a batch are joined to one array of code points with the bounds of its documents;
runs, classes and hashes are then computed for all documents of a chunk at once. A chunk
holds about ``CHUNK`` code points (a longer document is a chunk of its own), so the memory
of a task depends on its longest document, not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 250_000
U64 = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2^64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (xor-shift and multiply, three rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & MASK], dtype=U64))[0])


_tables: dict[str, np.ndarray] = {}


def symbol_table(lower: bool) -> np.ndarray:
    """A 64-bit value for every code point; with ``lower`` A-Z share those of a-z."""
    key = f"symbols-{lower}"
    if key not in _tables:
        table = mix64((np.arange(0x110000, dtype=U64) + U64(1)) * U64(BASE))
        if lower:
            table[65:91] = table[97:123]
        _tables[key] = table
    return _tables[key]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if "pow" not in _tables or len(_tables["pow"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("pow", BASE), ("inv", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["pow"][:n], _tables["inv"][:n]


def chunks(texts: Sequence[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` code points together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def clean(texts) -> list[str]:
    """The texts of a pandas column, null as empty."""
    return [t if isinstance(t, str) else "" for t in texts]


def join_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the bounds of each text in them."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return points, bounds


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask`` that stay inside one document."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    before[bounds[:-1][bounds[:-1] < len(mask)]] = False
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def owner(bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The document in which each run starts."""
    return np.searchsorted(bounds, starts, side="right") - 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of ``values``; equal spans hash alike anywhere."""
    power, inverse = _powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * power[:-1], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def give_back() -> None:
    """Return memory that is free in this process to the system."""
    import ctypes
    import sys

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def giving_back(run):
    """``run``, a function of a task's batches, that returns free memory at the task's end: the
    worker lives on, and would keep what the largest of its tasks took."""
    def task(batches):
        yield from run(batches)
        give_back()
    return task


def arrow_filter(keep):
    """For mapInArrow: the rows, with all columns as they are, whose text ``keep`` accepts
    (a function from a list of texts, null as empty, to a mask)."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = clean(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(keep(texts), type=pa.bool_()))
    return giving_back(run)


def arrow_rewrite(change):
    """For mapInArrow: the rows with ``text`` replaced by ``change(text)``; null stays null."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else change(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))
    return giving_back(run)
