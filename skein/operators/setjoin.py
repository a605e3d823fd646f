"""Exact set-similarity join of short and long texts by their words and character trigrams.

Pairs of sets with a Jaccard similarity of ``least`` or more share at least ``o`` items, and all but a few of either. Items are
in one global order, rare ones first. The smaller set of ``n`` items lacks at most ``d`` of them in the other one, so the first
``d + 2 g + 1`` items of it and a like prefix of the larger set share ``2 g + 1`` items: three of them fall in the same of ``g``
hash classes of items. Sets therefore meet by *triples of rare items* of one class (pairs or single items where a set has no more),
which few sets share even if each item by itself is in many. ``g`` grows with ``d``, so the number of triples grows with the size of a set.

One side is cut into shards, whose sorted keys are written once, by ranges of keys; tasks hold blocks of the other side and open the
shards by their paths, one range of keys of ``GROUP_ROWS`` texts at a time, so that a block looks its keys up once for all of these. Nothing
is capped: the sets that share a key are listed in slices of ``SLICE``. Parity
maps (a bit for the odd number of a set's items that fall on it) differ in no more bits than two sets in items and do not fill up: they
drop nearly all pairs that are not similar, first one of a single word for the rarer items. What is left is verified by the caller.
Hashing only adds candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_set
from ..session import materialize

if TYPE_CHECKING:
    import pyarrow as pa

#: Texts of a shard, texts that a task holds, and texts whose sets are cut at once; fewer if they have more than so many characters.
SHARD_ROWS, TASK_ROWS, BLOCK_ROWS = 100_000, 160_000, 4_000
#: Texts of the shards whose keys are looked up together, and ranges of keys (bits) by the kind of set.
GROUP_ROWS, RANGE_BITS = 1_000_000, {"w": 2, "g": 5}
HELD_CHARS, BLOCK_CHARS = 16_000_000, 1_000_000
#: Pairs that a task lists at once.
SLICE = 200_000
#: Bits of the hash that name an item's bucket; items are ordered by the number of texts of their bucket.
BUCKET_BITS = 16
#: Words of 64 bits of a parity map, by the kind of set. Rarer items that a text has on average; they have a map of one word besides.
MAP_WORDS, RARE = {"w": 2, "g": 4}, 40
#: Keys that are looked up at once, and pairs from which on those of one key are compared as a table.
STEP, TABLE = 1 << 18, 1 << 11

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_items(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) of all character trigrams, a shorter text being its own only one; an item is three code points, spread."""
    size = _chars(texts)
    code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
    owner = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    after = [np.where(place + k < size[owner], np.concatenate([code[k:], np.zeros(min(k, len(code)), np.uint64)]), _U(0)) for k in (1, 2)]
    keep = place < np.maximum(size - 2, 1)[owner]
    return owner[keep], _mix(((code << _U(42)) | (after[0] << _U(21)) | after[1])[keep])


def word_items(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) of arrays of hashes."""
    import pyarrow.compute as pc

    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(words)), size), _mix(words.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64))


def _chars(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _least_shared(n: np.ndarray, share: float) -> np.ndarray:
    return np.ceil(n * share - 1e-9).astype(np.int64)


def _classes(c: np.ndarray) -> np.ndarray:
    """``g`` of the triples of a class: 1, 2, 3, 6, 12, ..."""
    return np.where(c > 3, 3 << np.maximum(c - 4, 0), np.maximum(c - 1, 1))


def _class(n: np.ndarray, least: float) -> np.ndarray:
    """By the size of the smaller set: 0 for single items, 1 for pairs, from 2 on for triples in ``_classes`` of items; the more items
    the set may lack, the higher, by powers of two."""
    shared = _least_shared(n, 2 * least / (1 + least))
    c = 2 + np.log2(np.maximum(n - shared, 1)).astype(np.int64)
    for most in range(int(c.max(initial=0)), 2, -1):
        c = np.where((c == most) & (2 * _classes(c) + 1 > shared), c - 1, c)
    return np.where(shared > 2, c, (shared == 2).astype(np.int64))


def _together(c: np.ndarray) -> np.ndarray:
    """Items that the prefixes of a class must share, so that one of its keys is met."""
    return np.where(c > 1, 2 * _classes(c) + 1, c + 1)


class Sets:
    """Sets of a block of texts: ``n`` items of each, parity ``maps`` and those of the items ranked under ``bound`` (``rare``), and the
    items of all in order."""

    def __init__(self, rows: int, owner: np.ndarray, item: np.ndarray, rank: np.ndarray, bound: int, words: int) -> None:
        shift = _U(64 - BUCKET_BITS)
        code = self._in_order(rows, owner, (rank[(item >> shift).astype(np.int64)] << shift) | (item & ((_U(1) << shift) - _U(1))))
        new = np.ones(len(code), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
        self.owner, self.code = owner[new], code[new]
        self.n = np.bincount(self.owner, minlength=rows).astype(np.int64)
        self.place = np.arange(len(self.code)) - (np.cumsum(self.n) - self.n)[self.owner]
        self.hash = _mix(self.code)
        some = np.flatnonzero(self.n)
        begin = (np.cumsum(self.n) - self.n)[some]
        at = self.hash & _U(64 * words - 1)
        bit = _U(1) << (at & _U(63))
        self.maps = np.zeros((rows, words), np.uint64)
        for k in range(words if len(some) else 0):
            self.maps[some, k] = np.bitwise_xor.reduceat(np.where(at >> _U(6) == _U(k), bit, _U(0)), begin)
        self.rare = np.zeros((rows, 1), np.uint64)
        if len(some):
            self.rare[some, 0] = np.bitwise_xor.reduceat(np.where(self.code >> shift < _U(bound), _U(1) << (self.hash >> _U(58)), _U(0)), begin)

    @staticmethod
    def _in_order(rows: int, owner: np.ndarray, code: np.ndarray) -> np.ndarray:
        """``code`` sorted for each owner (owners ascend): rows of like numbers of items are sorted as one padded matrix."""
        size = np.bincount(owner, minlength=rows)
        start = np.cumsum(size) - size
        step = np.ceil(np.log(np.maximum(size, 1)) / np.log(1.25)).astype(np.int64)
        out = code.copy()
        for k in np.unique(step[size > 1]):
            mine = np.flatnonzero((step == k) & (size > 1))
            cell = np.arange(size[mine].max())
            real = cell < size[mine][:, None]
            at = (start[mine][:, None] + cell)[real]
            held = np.full(real.shape, ~_U(0))
            held[real] = code[at]
            held.sort(axis=1)
            out[at] = held[real]
        return out

    def _keys(self, rows: np.ndarray, c: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Entries (32 bits of a key, text) of the chosen ``rows``: triples of items of one class in the prefix, pairs, or single items."""
        at = np.flatnonzero(rows[self.owner] & (self.place < prefix[self.owner]))
        owner, h = self.owner[at], self.hash[at]
        k = c[owner]
        g = _classes(k)
        group = owner * int(g.max(initial=1)) + ((h >> _U(16)) % g.astype(np.uint64)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        owner, h, k, group = owner[order], h[order], k[order], group[order]
        tag = owner.astype(np.uint64)
        low, middle, high = h * _U(0x9E3779B97F4A7C15) + k.astype(np.uint64), h * _U(0xC2B2AE3D27D4EB4F), h * _U(0xD6E8FEB86659FD93)
        entry = lambda x, first: (x >> _U(32) << _U(32)) | tag[first]
        first = np.flatnonzero(k == 0)
        found = [entry(low[first], first)]
        first = np.flatnonzero(k > 0)
        lag = 0
        while len(first):
            lag += 1
            first = first[first + lag < len(group)]
            first = first[group[first + lag] == group[first]]
            ends = low[first] + high[first + lag]
            pair = k[first] == 1
            if pair.any():
                found.append(entry(ends[pair], first[pair]))
            triple = ~pair
            three, ends = first[triple], ends[triple]
            found += [entry(ends + middle[three + j], three) for j in range(1, lag)]
        return np.concatenate(found)

    def as_smaller(self, least: float) -> np.ndarray:
        """Entries by which the sets are found by larger or equal ones."""
        c = _class(self.n, least)
        return self._keys(self.n > 0, c, self.n - _least_shared(self.n, 2 * least / (1 + least)) + _together(c))

    def as_larger(self, least: float) -> np.ndarray:
        """Entries by which the sets find smaller or equal ones, of whichever class these are."""
        shared = _least_shared(self.n, least)
        low, high = _class(shared, least), _class(self.n, least)
        found = [np.zeros(0, np.uint64)]
        for c in range(int(high.max(initial=0)) + 1):
            rows = (low <= c) & (c <= high)
            if rows.any():
                found.append(self._keys(rows, np.full(len(self.n), c), self.n - shared + int(_together(np.array(c)))))
        return np.concatenate(found)


def _bits(maps: np.ndarray) -> np.ndarray:
    """Number of bits of each row of words, by columns as there are few."""
    out = np.zeros(len(maps), np.int32)
    for k in range(maps.shape[1]):
        out += np.bitwise_count(maps[:, k])
    return out


def matches(s: dict, entry: np.ndarray, index: dict, least: float) -> Iterator[np.ndarray]:
    """Codes (text << 32 | text of the index) of the pairs that may be similar, not those of one ``group``. ``s`` and the index have
    ``n``, ``maps`` and ``rare`` of the texts, and ``group`` or None; ``entry`` and the index's entries are sorted."""
    share = (1 - least) / (1 + least)
    shared, bound = _least_shared(s["n"], least), (2 * s["n"] * share + 1e-9).astype(np.int32)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for a, b in _met(s["rare"], bound, entry, index):
        held.append((a, b))
        size += len(a)
        if size >= SLICE:
            yield _near(s, shared, share, index, *map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield _near(s, shared, share, index, *map(np.concatenate, zip(*held)))


def _near(s: dict, shared: np.ndarray, share: float, index: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of the pairs that sizes, groups and maps leave."""
    na, nb = s["n"][a], index["n"][b]
    fit = (nb <= na) & (nb >= shared[a])
    if s["group"] is not None:
        fit &= s["group"][a] != index["group"][b]
    a, b, most = a[fit], b[fit], ((na + nb)[fit] * share + 1e-9).astype(np.int64)
    near = np.flatnonzero(_bits(s["maps"][a] ^ index["maps"][b]) <= most)
    a, b = a[near], b[near]
    return np.unique(a.astype(np.int64) << 32 | b)


def _met(rare: np.ndarray, bound: np.ndarray, entry: np.ndarray, index: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, text of the index) that share a key and whose maps of rare items differ by ``bound`` or less, in parts of bounded size."""
    theirs, mine = index["rare"][:, 0][index["owner"]], np.ascontiguousarray(rare[:, 0])
    bound = np.minimum(bound, 255).astype(np.uint8)
    for at in range(0, len(entry) if len(index["key"]) else 0, STEP):
        key = (entry[at : at + STEP] >> _U(32)).astype(np.uint32)
        lo = np.searchsorted(index["key"], key, "left")
        some = np.flatnonzero(index["key"][np.minimum(lo, len(index["key"]) - 1)] == key)
        if not len(some):
            continue
        key, lo, owner = key[some], lo[some], (entry[at + some] & _U(0xFFFFFFFF)).astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.searchsorted(index["key"], key[begin], "right") - lo[begin]
        texts = np.diff(np.append(begin, len(key)))
        table = many * texts >= TABLE
        for first, n, start, k in zip(*(x[table].tolist() for x in (begin, texts, lo[begin], many))):
            # both sides in tiles of at most SLICE pairs
            for left in range(start, start + k, SLICE):
                b = index["owner"][left : min(left + SLICE, start + k)]
                their = theirs[left : left + len(b)]
                tall = max(SLICE // 4 // len(b), 1)
                for top in range(first, first + n, tall):
                    a = owner[top : min(top + tall, first + n)]
                    near = np.flatnonzero(np.bitwise_count(mine[a][:, None] ^ their) <= bound[a][:, None])
                    if len(near):
                        i, j = np.divmod(near, len(b))
                        yield a[i], b[j]
        few = ~np.repeat(table, texts)
        lo, owner, many = lo[few], owner[few], np.repeat(many, texts)[few]
        edges = np.cumsum(many)
        cut = 0
        while cut < len(lo):
            to = max(int(np.searchsorted(edges, (edges[cut - 1] if cut else 0) + SLICE, "right")), cut + 1)
            k = many[cut:to]
            some, last = owner[cut:to], np.cumsum(k)
            at = np.arange(int(last[-1])) + np.repeat(lo[cut:to] - (last - k), k)
            near = np.flatnonzero(np.bitwise_count(np.repeat(mine[some], k) ^ theirs[at]) <= np.repeat(bound[some], k))
            if len(near):
                yield some[np.searchsorted(last, near, "right")], index["owner"][at[near]]
            cut = to


def _blocks(rows: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of bounded size, and the row at which each begins."""
    n = len(rows)
    block = np.cumsum(_chars(rows.column("text"))) // BLOCK_CHARS * n + np.arange(n) // BLOCK_ROWS
    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), n]
    for first, last in zip(edges, edges[1:]):
        yield first, rows.slice(first, last - first)


def _items(block: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return word_items(block.column("w")) if kind == "w" else gram_items(block.column("text"))


def _sets(block: pa.RecordBatch, ranks: dict[str, tuple[np.ndarray, int]]) -> dict[str, Sets]:
    """The sets of each kind of a block."""
    return {kind: Sets(len(block), *_items(block, kind), *rank, MAP_WORDS[kind]) for kind, rank in ranks.items()}


def _count(kinds: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        seen = {kind: np.zeros(1 << BUCKET_BITS, np.int64) for kind in kinds}
        for batch in batches:
            for _, part in _blocks(batch):
                for kind in kinds:
                    seen[kind] += np.bincount((_items(part, kind)[1] >> _U(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        for kind, n in seen.items():
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(bucket), pa.string()), "bucket": bucket.astype(np.int32), "n": n[bucket]})

    return run


def _packed(entry: np.ndarray) -> np.ndarray:
    """Sorted entries as steps of keys and texts, each in two planes of 16 bits of which the upper ones are nearly empty."""
    key = (entry >> _U(32)).astype(np.uint32)
    both = np.stack([np.diff(key, prepend=np.uint32(0)), entry.astype(np.uint32)])
    return np.ascontiguousarray(np.stack([both & np.uint32(0xFFFF), both >> np.uint32(16)]).astype(np.uint16))


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and texts of the entries."""
    low, high = packed.reshape(2, 2, -1)
    both = low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16))
    return np.cumsum(both[0], dtype=np.uint32), both[1].astype(np.int32)


def _ranges(entry: np.ndarray, kind: str) -> list[np.ndarray]:
    """The sorted entries by ranges of their keys."""
    bits = RANGE_BITS[kind]
    first = np.arange(1, 1 << bits, dtype=np.uint64) << _U(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.split(entry, np.searchsorted(entry, first))


def _of_texts(kind: str) -> dict[str, type]:
    """The arrays of a shard's index that are no entries."""
    return {f"{kind}_n": np.int32, f"{kind}_maps": np.uint64, f"{kind}_rare": np.uint64}


def _index(kinds: list[str]) -> list[str]:
    """The arrays of a shard's index."""
    return [x for kind in kinds for x in (*_of_texts(kind), *(f"{kind}_entry{r}" for r in range(1 << RANGE_BITS[kind])))]


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` rows, or fewer of many characters; none is kept here while it is in use."""
    import pyarrow as pa

    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        out = pa.concat_batches(held)
        held.clear()
        return out

    rows = chars = 0
    for batch in batches:
        held.append(batch)
        rows, chars = rows + len(batch), chars + int(_chars(batch.column("text")).sum())
        del batch
        if rows >= most or chars >= HELD_CHARS:
            rows = chars = 0
            yield joined()
    if rows:
        yield joined()


def _trim() -> None:
    """Gives memory that is free back to the system, where it can be asked to take it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):
        pass


def _cut(rows: pa.RecordBatch, ranks: dict[str, tuple[np.ndarray, int]], entries: Callable) -> dict[str, dict]:
    """By kind: ``n``, ``maps`` and ``rare`` of the texts, and the sorted ``entries`` of each block, by ranges of keys."""
    parts: dict[str, dict] = {kind: {x: [] for x in ("n", "maps", "rare", "entry")} for kind in ranks}
    for at, block in _blocks(rows):
        for kind, s in _sets(block, ranks).items():
            entry = entries(s, kind)
            entry.sort()
            # numbers of a block's texts take two bytes
            held = at, [((x >> _U(32)).astype(np.uint32), x.astype(np.uint16)) for x in _ranges(entry, kind)]
            for x, v in (("n", s.n.astype(np.int32)), ("maps", s.maps), ("rare", s.rare), ("entry", held)):
                parts[kind][x].append(v)
            del s, entry
    return {kind: {x: np.concatenate(mine[x]) for x in ("n", "maps", "rare")} | {"entry": mine["entry"]} for kind, mine in parts.items()}


def _range(entry: list[tuple[int, list]], r: int) -> np.ndarray:
    """The entries of one range of all blocks, sorted."""
    out = np.concatenate([(key.astype(np.uint64) << _U(32)) + (owner + _U(at)) for at, block in entry for key, owner in (block[r],)])
    out.sort()
    return out


def _build(ranks: dict[str, tuple[np.ndarray, int]], least: dict[str, float]) -> Callable:
    """The indexes of shards: sizes, maps and sorted entries of each kind of set, beside keys and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for rows in _held(batches, SHARD_ROWS):
            out = {}
            for kind, mine in _cut(rows, ranks, lambda s, kind: s.as_smaller(least[kind])).items():
                out |= {f"{kind}_{x}": mine[x] for x in ("n", "maps", "rare")} | {f"{kind}_entry{r}": _packed(_range(mine["entry"], r)) for r in range(1 << RANGE_BITS[kind])}
            out = {x: pa.array([out[x].tobytes()], pa.binary()) for x in _index(list(ranks))}
            out["group"] = pa.array([rows.column("group").to_numpy(zero_copy_only=False).tobytes() if "group" in rows.schema.names else None], pa.binary())
            if "key" in rows.schema.names:
                out["key"] = whole(rows.column("key"))
            yield pa.RecordBatch.from_pydict(out | {"text": whole(rows.column("text"))})

    return run


class Shard:
    """One row of a file of the shared folder, wherever it lies."""

    def __init__(self, file, row: int, group: int) -> None:
        self.file, self.row, self.group = file, row, group

    def column(self, name: str):
        return self.file.read_row_group(self.group, columns=[name]).column(0)[self.row]

    def array(self, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(self.column(name).as_buffer(), kind)


def _groups(paths: list[str], some: str) -> Iterator[list[tuple[Shard, int]]]:
    """Shards and their numbers of texts, of about ``GROUP_ROWS`` texts together. some: a kind of set."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    held: list[tuple[Shard, int]] = []
    for path in paths:
        system, inner = pafs.FileSystem.from_uri(path)
        file = pq.ParquetFile(system.open_input_file(inner))
        for group in range(file.num_row_groups):
            for row, n in enumerate(file.read_row_group(group, columns=[f"{some}_n"]).column(0)):
                held.append((Shard(file, row, group), len(n.as_buffer()) // 4))
                if sum(rows for _, rows in held) >= GROUP_ROWS:
                    yield held
                    held = []
    if held:
        yield held


def _opened(index: dict, kind: str, first: tuple = (0,)) -> dict:
    """An index of one kind of set as :func:`matches` reads it. Its entries are packed, or a list of those of several shards,
    whose texts begin at ``first``."""
    packed = index[f"{kind}_entry"]
    own = {x: index[f"{kind}_{x}"] for x in ("n", "maps", "rare")} | {"group": index["group"]}
    parts = [_unpacked(x) for x in (packed if isinstance(packed, list) else [packed])]
    if len(parts) == 1:
        return own | {"key": parts[0][0], "owner": parts[0][1]}
    entry = np.concatenate([(key.astype(np.uint64) << _U(32)) | (owner + at).astype(np.uint64) for at, (key, owner) in zip(first, parts)])
    entry.sort()
    return own | {"key": (entry >> _U(32)).astype(np.uint32), "owner": entry.astype(np.uint32).astype(np.int32)}


def _opened_ranges(shards: list[Shard], first: list[int], kind: str, group: np.ndarray | None) -> Iterator[dict]:
    """The index of one kind of set of the shards, by ranges of keys."""
    own: dict = {"group": group}
    for name, of in _of_texts(kind).items():
        for at, end, x in zip(first, first[1:], shards):  # one shard's at a time beside the whole
            part = x.array(name, of).reshape(end - at, -1)
            own.setdefault(name, np.empty((first[-1], part.shape[1]), of))[at:end] = part
    own[f"{kind}_n"] = own[f"{kind}_n"][:, 0]
    for r in range(1 << RANGE_BITS[kind]):
        yield _opened(own | {f"{kind}_entry": [x.array(f"{kind}_entry{r}", np.uint16) for x in shards]}, kind, first)


def _stream(paths: list[str], ranks: dict[str, tuple[np.ndarray, int]], least: dict[str, float], within: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _held(batches, TASK_ROWS)
        while own := [x for _, x in zip(range(1), tables)]:
            yield from search(own)

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        own = held.pop()
        mine = _cut(own, ranks, lambda s, kind: s.as_larger(least[kind]))
        texts = own.column("text")
        keys = own.column("key") if "key" in own.schema.names else texts
        grouped = own.column("group").to_numpy(zero_copy_only=False) if "group" in own.schema.names else None
        del own
        _trim()
        for held in _groups(paths, next(iter(ranks))):
            shards, rows = [x for x, _ in held], [n for _, n in held]
            first = np.cumsum([0, *rows]).tolist()
            group = None if grouped is None else np.concatenate([x.array("group", np.int64) for x in shards])
            codes = [np.zeros(0, np.int64)]
            for kind, s in mine.items():
                for r, index in enumerate(_opened_ranges(shards, first, kind, group)):
                    codes.extend(matches(s | {"group": grouped}, _range(s["entry"], r), index, least[kind]))
                    del index
            pairs = np.unique(np.concatenate(codes))
            del codes
            # by shards, as their texts are read one shard after the other
            place = np.searchsorted(first, pairs & 0xFFFFFFFF, "right") - 1
            for k, x in enumerate(shards):
                found = pairs[place == k]
                if not len(found):
                    continue
                their_texts = x.column("text").values
                their_keys = their_texts if keys is texts else x.column("key").values
                for begin in range(0, len(found), BLOCK_ROWS):
                    part = found[begin : begin + BLOCK_ROWS]
                    a, b = part >> 32, (part & 0xFFFFFFFF) - first[k]
                    if within:
                        other = pc.not_equal(keys.take(pa.array(a)), their_keys.take(pa.array(b))).to_numpy(zero_copy_only=False)
                        a, b = a[other], b[other]
                    if len(a):
                        yield pa.RecordBatch.from_pydict({x: of.take(pa.array(i)) for x, of, i in (("a", keys, a), ("b", their_keys, b), ("ta", texts, a), ("tb", their_texts, b))})
                del their_texts, their_keys
            _trim()

    return run


def candidates(left: DataFrame, right: DataFrame | None, words: float | None, grams: float | None, items=lambda text: F.transform(word_set(text), lambda w: F.xxhash64(w))) -> DataFrame:
    """``a, b, ta, tb``: keys and texts of all pairs of ``key, text`` whose sets of words or of trigrams may be similar by
    these shares, and of few others; within ``left`` (each pair in either order, or both) or from ``left`` to ``right``. Empty sets match nothing.
    Where the tables have no ``key``, the texts are the keys.
    ``items`` gives the hashes of a text's words. Where the tables have a number ``group``, pairs of equal ones are left out."""
    least = {k: v for k, v in (("w", words), ("g", grams)) if v is not None}
    spark = left.sparkSession
    own = [c for c in ("key", "group") if c in left.columns]
    kind = left.schema["key" if "key" in own else "text"].dataType.simpleString()
    pair = f"a {kind}, b {kind}, ta string, tb string"
    word = items(F.col("text")) if "w" in least else F.array().cast("array<bigint>")
    sides = [materialize(df.select("text", word.alias("w"), *own), "near") for df in (left, right) if df is not None]
    every = sides[0] if right is None else sides[0].unionByName(sides[1])
    counts = every.mapInArrow(_count(sorted(least)), "kind string, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    sizes = [df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first() for df in sides]
    ranks = {}
    for k in least:
        n = np.zeros(1 << BUCKET_BITS, np.int64)
        mine = counts[counts["kind"] == k]
        n[mine["bucket"].to_numpy()] = mine["n"].to_numpy()
        rank = np.empty(1 << BUCKET_BITS, np.uint64)
        rank[np.argsort(n, kind="stable")] = np.arange(1 << BUCKET_BITS, dtype=np.uint64)
        ranks[k] = rank, int(np.searchsorted(np.cumsum(np.sort(n)), RARE * sum(rows for rows, _ in sizes), "right"))

    slots = spark.sparkContext.defaultParallelism

    def spread(side: DataFrame, rows: int, chars: int) -> DataFrame:
        """The written table as it lies, unless its files give too few tasks."""
        least_tasks = max(min(-(-rows // BLOCK_ROWS), slots), 1)
        return side if side.rdd.getNumPartitions() >= least_tasks else side.repartition(max(least_tasks, -(-rows // TASK_ROWS), -(-chars // HELD_CHARS)), "text")

    found = None
    for i, j in [(0, 0)] if right is None else [(0, 1), (1, 0)]:
        schema = ", ".join(f"{x} binary" for x in (*_index(list(least)), "group")) + f", key array<{kind}>" * ("key" in own) + ", text array<string>"
        paths = sorted(materialize(spread(sides[j], *sizes[j]).mapInArrow(_build(ranks, least), schema), "near_index").inputFiles())
        part = spread(sides[i], *sizes[i]).mapInArrow(_stream(paths, ranks, least, right is None), pair)
        part = part if i == 0 else part.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("tb").alias("ta"), F.col("ta").alias("tb"))
        found = part if found is None else found.unionByName(part)
    return found
