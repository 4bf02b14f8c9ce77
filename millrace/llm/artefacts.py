"""What tasks build and other tasks read: arrays in pieces, as Parquet tables in the shared folder, and bit filters made of them."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE = "shard string, array string, kind string, length bigint, at bigint, raw binary"
_SCHEMA = pa.schema([("shard", pa.string()), ("array", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("at", pa.int64()), ("raw", pa.binary())])
STEP = 8 << 20  # bytes of a piece


def pieces(shard: str, arrays: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A shard's arrays as rows (PIECE), an empty array too."""
    for name, array in arrays.items():
        raw = memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b""
        for at in range(0, max(len(raw), 1), STEP):
            yield pa.RecordBatch.from_pylist([{"shard": shard, "array": name, "kind": str(array.dtype), "length": len(array), "at": at, "raw": bytes(raw[at : at + STEP])}], schema=_SCHEMA)


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (None, path)
    return ds.dataset(folder, filesystem=system, format="parquet")


def read(path: str, shard: str | None = None, array: str | tuple[str, ...] | None = None) -> Iterator[tuple[str, str, np.ndarray]]:
    """(shard, array, values) of the wanted arrays below path, a piece in memory at a time; pieces may come in any order."""
    import pyarrow.dataset as ds

    wanted = None
    for name, value in (("shard", shard), ("array", array)):
        if value is not None:
            here = ds.field(name).isin(value) if isinstance(value, tuple) else ds.field(name) == value
            wanted = here if wanted is None else wanted & here
    open_: dict[tuple[str, str], tuple[np.ndarray, list[int]]] = {}
    for batch in _dataset(path).to_batches(filter=wanted, batch_size=1, batch_readahead=0, fragment_readahead=0):
        for r in batch.to_pylist():
            values, left = open_.setdefault((r["shard"], r["array"]), (np.empty(r["length"], dtype=r["kind"]), [r["length"] * np.dtype(r["kind"]).itemsize]))
            if len(values):
                memoryview(values).cast("B")[r["at"] : r["at"] + len(r["raw"])] = r["raw"]
            left[0] -= len(r["raw"])
            if not left[0]:
                yield r["shard"], r["array"], open_.pop((r["shard"], r["array"]))[0]


def kept(path: str, name: str, make: Callable[[], object], most: int = 1) -> object:
    """What make() gives, held by the Python worker for later tasks; things of other paths go first, and the oldest beyond `most` of this one."""
    held = sys.__dict__.setdefault("_millrace_artefacts", {})
    if (path, name) not in held:
        for key in [k for k in held if k[0] != path]:
            del held[key]
        others = [k for k in held if k[1] != "filter"]
        if name != "filter" and len(others) >= most:
            del held[others[0]]
        held[path, name] = make()
    return held[path, name]


def filter_bits(elements: int) -> int:
    """Bits of a hash that a filter looks at: 16 places an element, from 2^12 to 2^30 places (128 MB), beyond which it lets more through."""
    return int(np.clip(int(16 * max(elements, 1) - 1).bit_length(), 12, 30))


def filter_places(hashes: np.ndarray) -> np.ndarray:
    """Ascending distinct 32-bit places of hashes, from which a filter of any size up to 2^32 is made."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def load_filter(path: str, bits: int) -> np.ndarray:
    """The bit vector of all shards' places below path."""
    out = np.zeros(max(1, (1 << bits) >> 6), dtype=np.uint64)
    for _, _, places in read(path, array="places"):
        at = (places >> np.uint32(32 - bits)).astype(np.int64)
        word, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
        if len(word):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[starts]] |= np.bitwise_or.reduceat(bit, starts)
    return out


def passes(filter_: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of the filter's elements; True for all that are."""
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (filter_[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def count_bits(elements: int) -> int:
    """Bits of a hash that a table of counts looks at: 16 places an element, from 2^12 to 2^26 places (128 MB), beyond which elements share counts."""
    return min(filter_bits(elements), 26)


def load_counts(path: str, bits: int) -> np.ndarray:
    """How often the hashes of each place occur in all shards below path, 65,535 at most: the sums of the arrays `counts` beside `places`."""
    out = np.zeros(1 << bits, dtype=np.uint16)
    open_: dict[str, dict[str, np.ndarray]] = {}
    for shard, name, values in read(path, array=("places", "counts")):
        have = open_.setdefault(shard, {})
        have[name] = values
        if len(have) < 2:
            continue
        at, n = (have["places"] >> np.uint32(32 - bits)).astype(np.int64), have["counts"].astype(np.int64)
        del open_[shard]
        if len(at):
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[starts]] = np.minimum(out[at[starts]] + np.add.reduceat(n, starts), 65535)
    return out
