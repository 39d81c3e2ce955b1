"""Byte-level BPE encoding and decoding by ranks, with a hierarchical-bitmap queue of merges.

Pre-tokens are linked lists of parts. Every pair of neighbours that forms a ranked token waits in the bucket of its
rank; three levels of 64-way bitmaps over the ranks let find-first-set name the lowest rank with a bucket. An entry is
stale, and skipped, when its pair has changed since. Work follows the number of merges, whatever the length, so texts
that are one long pre-token are fine.

All new pre-tokens of about three megabytes of texts share one queue: their lists lie in common arrays, and a bucket's positions are
merged together. Within a pre-token, positions of one rank that overlap merge from the left. A pre-token in which a
merge makes a pair of a lower rank while others of its rank wait goes one by one (merge), as that order then matters.
Pre-tokens that recur in a task are encoded once and remembered, up to a bounded size.

Null texts are encoded as empty; repeated or null ids stay rows of their own, and columns other than id and text are not
looked at. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.texts import chunks

#: Pre-tokens, and bytes of their ids, that a task remembers; checked before each group of texts.
REMEMBERED = 150_000
REMEMBERED_BYTES = 4_000_000
#: Bytes of whole texts that are encoded together (a longer text goes alone).
TOGETHER = 3 << 20


class Ranks:
    """A set of ranks; lowest() and removal by find-first-set on three levels of bitmaps."""

    __slots__ = ("leaves", "nodes", "root")

    def __init__(self) -> None:
        self.leaves: dict[int, int] = {}  # rank >> 6: which of its 64 ranks are in
        self.nodes: dict[int, int] = {}  # rank >> 12: which of its 64 leaves are not empty
        self.root = 0  # which nodes are not empty

    def add(self, rank: int) -> None:
        leaf, node = rank >> 6, rank >> 12
        self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << (rank & 63)
        self.nodes[node] = self.nodes.get(node, 0) | 1 << (leaf & 63)
        self.root |= 1 << node

    def lowest(self) -> int:
        """Takes out the lowest rank; -1 if there is none."""
        if not self.root:
            return -1
        node = (self.root & -self.root).bit_length() - 1
        bits = self.nodes[node]
        leaf = node << 6 | (bits & -bits).bit_length() - 1
        low = self.leaves[leaf]
        self.leaves[leaf] = low & low - 1
        if not self.leaves[leaf]:
            self.nodes[node] = bits & bits - 1
            if not self.nodes[node]:
                self.root &= self.root - 1
        return leaf << 6 | (low & -low).bit_length() - 1


class RankQueue:
    """Single positions by rank; pop gives the leftmost position of the lowest rank."""

    __slots__ = ("buckets", "ranks")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.ranks = Ranks()

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.setdefault(rank, [])
        if not bucket:
            self.ranks.add(rank)
        heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        rank = self.ranks.lowest()
        if rank < 0:
            return None
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if bucket:
            self.ranks.add(rank)
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    ends = list(range(1, n + 1))  # of the part that begins at a position; 0 once it is merged away
    before = list(range(-1, n - 1))  # where the part to the left begins
    queue = RankQueue()
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            queue.push(rank, i)
    while (found := queue.pop()) is not None:
        rank, i = found
        middle = ends[i]
        if not middle or middle >= n or ranks.get(piece[i : ends[middle]]) != rank:
            continue
        end = ends[i] = ends[middle]
        ends[middle] = 0
        if end < n:
            before[end] = i
            new = ranks.get(piece[i : ends[end]])
            if new is not None:
                queue.push(new, i)
        left = before[i]
        if left >= 0:
            new = ranks.get(piece[left:end])
            if new is not None:
                queue.push(new, left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Pairs:
    """The rank of the token that two neighbouring tokens form, for arrays of them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.width = max(ranks.values(), default=0) + 1
        keys, values = [], []
        get = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = get(token[:cut])
                if left is not None:
                    right = get(token[cut:])
                    if right is not None:
                        keys.append(left * self.width + right)
                        values.append(rank)
        keys, values = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], -1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where there is no such token."""
        wanted = left * self.width + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], -1)


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], pairs: Pairs, single: np.ndarray) -> list[bytes]:
    """The ids of each pre-token, as little-endian unsigned 32-bit integers. single: the rank of each byte."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    n = len(data)
    ids = np.append(single[data], 0)  # of the part that begins at a position; position n stands for no part
    after = np.arange(1, n + 2)
    after[ends - 1] = n
    after[n] = n
    before = np.arange(-1, n)
    before[np.append(0, ends[:-1])] = n
    before[n] = n
    alive = np.ones(n + 1, dtype=bool)
    waits = np.full(n + 1, -1, dtype=np.int64)  # the rank of the pair that begins at a position
    first = np.flatnonzero(after[:n] < n)
    waits[first] = pairs(ids[first], ids[after[first]])
    buckets: dict[int, list[np.ndarray]] = {}
    queue = Ranks()

    def push(positions: np.ndarray) -> None:
        found = waits[positions]
        positions, found = positions[found >= 0], found[found >= 0]
        order = np.argsort(found, kind="stable")
        positions, found = positions[order], found[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        for rank, part in zip(found[np.append(0, cuts)].tolist() if len(found) else [], np.split(positions, cuts), strict=False):
            if rank in buckets:
                buckets[rank].append(part)
            else:
                buckets[rank] = [part]
                queue.add(rank)

    push(first)
    by_one: set[int] = set()
    while (rank := queue.lowest()) >= 0:
        parts = buckets.pop(rank)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[waits[at] == rank]
        if not len(at):
            continue
        clash = after[at[:-1]] == at[1:]
        if clash.any():  # in a run of overlapping pairs, every other one from the left
            run = np.append(0, np.cumsum(~clash))
            place = np.arange(len(at)) - np.searchsorted(run, run)
            at = at[place % 2 == 0]
        middle = after[at]
        right = after[middle]
        ids[at] = rank
        after[at] = right
        before[right] = at
        before[n] = n
        alive[middle] = False
        waits[middle] = -1
        left = before[at]
        waits[at] = np.where(right < n, pairs(ids[at], ids[right]), -1)
        left = left[left < n]
        waits[left] = pairs(ids[left], ids[after[left]])
        new = np.concatenate([at, left])
        lower = new[(waits[new] >= 0) & (waits[new] < rank)]
        if len(lower):
            by_one.update(np.searchsorted(ends, lower, side="right").tolist())
        push(np.unique(new))
    kept = ids[:n][alive[:n]].astype("<u4")
    counts = np.diff(np.append(0, np.cumsum(alive[:n])[ends - 1]))
    raw, stops = kept.tobytes(), (np.cumsum(counts) * 4).tolist()
    out = [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
    for i in by_one:
        out[i] = np.array(merge(pieces[i], ranks), dtype="<u4").tobytes()
    return out


class _Numbers(dict):
    """Numbers new keys in order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Coder:
    """Encodes and decodes with ranks given as lines of a .tiktoken file and a pattern of pre-tokens."""

    def __init__(self, lines: list[bytes], pattern: str) -> None:
        self.lines, self.pattern, self.remembered = lines, pattern, 0

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.lines)}

    @cached_property
    def tokens(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.ranks)

    @cached_property
    def single(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    @cached_property
    def split(self):
        return regex.compile(self.pattern)

    @cached_property
    def known(self) -> tuple[_Numbers, list[bytes]]:
        """Pre-tokens by number, and the ids of each number."""
        return _Numbers(), []

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        numbers, made = self.known
        if len(made) > REMEMBERED or self.remembered > REMEMBERED_BYTES:
            numbers.clear()
            made.clear()
            self.remembered = 0
        findall, number = self.split.findall, numbers.__getitem__
        listed = [np.fromiter(map(number, findall(t)), dtype=np.int32) for t in texts]
        fresh = [p.encode() for p in list(numbers)[len(made) :]]
        found: list[bytes | None] = [None if (whole := self.ranks.get(p)) is None else whole.to_bytes(4, "little") for p in fresh]
        todo = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(todo, merge_all([fresh[i] for i in todo], self.ranks, self.pairs, self.single) if todo else [], strict=True):
            found[i] = ids
        made.extend(found)
        self.remembered += sum(map(len, found))
        get = made.__getitem__
        for each in listed:
            yield b"".join(map(get, each.tolist()))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def coder(path: str, pattern: str) -> Coder:
    """Reads a rank file on the driver; it is small (under a megabyte) and goes to the tasks by broadcast."""
    with open(path, "rb") as f:
        return Coder(f.read().splitlines(), pattern)


def encode_documents(docs: DataFrame, made: Coder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array<int>): the ids of every whole text; null is empty."""
    return _each(docs, made, key, text, f"{key} long, ids array<int>", lambda c, ids: [np.frombuffer(ids, dtype="<i4")], {"ids": pa.list_(pa.int32())})


def digest_documents(docs: DataFrame, made: Coder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes they decode to)."""

    def digest(c: Coder, ids: bytes) -> list:
        return [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()]

    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _each(docs, made, key, text, schema, digest, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})


def _each(docs: DataFrame, made: Coder, key: str, text: str, schema: str, work, types: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for lo, hi, _, _ in chunks(batch.column(1), TOGETHER):
                rows = [work(c, ids) for ids in c.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(list(r), t) for r, t in zip(zip(*rows, strict=True), types.values(), strict=True)]], names=[key, *types])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(run, schema)


def tokenizer_file(name: str) -> tuple[str, str]:
    """(path, pattern) of one of the public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
