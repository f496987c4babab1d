"""Operator 6: language-model scores from a hierarchical Pitman-Yor model."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, free_shuffles, materialize, table

#: Word ids are 56 hash bits. END is the end token as a word; START, past every id, the context of a first word.
END, START = np.uint64(0), np.uint64(1 << 56)
BLOCK = 2_000_000  # tokens held at once
THETA = 1.0  # concentration of every restaurant

#: Tables travel and are stored as rows of these: a grid bucket or a node, and packed arrays.
ROW = "kind string, bucket int, node int, block string, payload binary"
Row = tuple[str, int | None, int | None, str | None, bytes]


# -- packing --------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays; bytes of one place lie together."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        turned = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()
        parts.append(f"{raw.dtype.str}:{len(raw)};".encode() + turned)
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
    for size in sizes.tolist():
        part = raw[at : at + size]
        at += size
        cut = part.index(b";")
        dtype, length = part[:cut].decode().rsplit(":", 1)
        item = np.dtype(dtype).itemsize
        body = np.frombuffer(part, np.uint8, int(length) * item, cut + 1).reshape(item, int(length))
        out.append(np.ascontiguousarray(body.T).view(dtype).ravel())
    return out


def deltas(ids: np.ndarray) -> np.ndarray:
    return np.diff(ids, prepend=np.uint64(0))


def steps(numbers: np.ndarray) -> np.ndarray:
    """Differences modulo 2^32, which ``np.cumsum`` in uint32 undoes."""
    return np.diff(numbers.astype(np.uint32), prepend=np.uint32(0))


def u32(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32)


def rows_table(rows: list[Row]) -> pa.Table:
    names, types = [x.split()[0] for x in ROW.split(", ")], (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary())
    return pa.table([pa.array([r[n] for r in rows], t) for n, t in enumerate(types)], names=names)


# -- tokens ---------------------------------------------------------------------------------------


def word_id(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 8 or 1


def shard(ids: np.ndarray, side: int) -> np.ndarray:
    return (ids % np.uint64(side)).astype(np.int64)


def tokenize(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def cell_numbers(tokens: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """For each token the number of its (word, previous word) cell, of ``n`` words; that of a first word is ``n``."""
    out = tokens * np.int64(n + 1)
    out[1:] += tokens[:-1]
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    out[starts] = tokens[starts] * np.int64(n + 1) + n
    return out


def distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the place of each among them; as ``np.unique``, in less memory."""
    order = np.argsort(numbers)
    ordered = numbers[order]
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    where = np.empty(len(ordered), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], where


def by_bucket(cells: np.ndarray, shards: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, previous word, bucket and place among ``cells`` (numbers in order) of each cell, by bucket."""
    n = len(shards)
    word, context = cells // (n + 1), cells % (n + 1)
    bucket = np.r_[shards, shard(START, side)][context] * side + shards[word]
    order = np.argsort(bucket, kind="stable")
    return word[order], context[order], bucket[order], order


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _count_blocks(side: int, least: int = BLOCK):
    """Input: key, binary text, train. Output, per block of whole documents: its "own" row (tokens, lengths, keys; bucket: a negative number of its own), and one "request" per bucket: its cells in order with their training counts. A block is named by its content, so that parts of different tries never meet."""

    def close(seq: int, keys: pa.Array, docs: list[np.ndarray], train: list[bool], vocab: dict[bytes, int]) -> pa.RecordBatch:
        ids, place = np.unique(np.array([END, *map(word_id, vocab)], np.uint64), return_inverse=True)
        lengths = np.array([len(d) + 1 for d in docs], np.int64)
        local = np.zeros(int(lengths.sum()), np.int32)  # 0: the end token
        inside = np.ones(len(local), bool)
        inside[np.cumsum(lengths) - 1] = False
        local[inside] = np.concatenate(docs)
        tokens, shards = place.astype(np.int32)[local], shard(ids, side)
        common = np.argsort(-np.bincount(tokens, minlength=len(ids)), kind="stable")
        rank = np.empty(len(ids), np.uint32)
        rank[common] = np.arange(len(ids))
        own = pack(rank[tokens], u32(common), shards.astype(np.uint16), u32(lengths), np.frombuffer(_ipc(keys), np.uint8))
        block = f"{TaskContext.get().partitionId()}-{seq}-{xxhash.xxh64_hexdigest(own)}"
        out: list[Row] = [("own", -1 - (xxhash.xxh64_intdigest(block) & 0x3FFFFFFF), None, block, own)]
        cells, where = distinct(cell_numbers(tokens, lengths, len(ids)))
        counts = u32(np.bincount(where[np.repeat(np.array(train), lengths)], minlength=len(cells)))
        word, context, bucket, order = by_bucket(cells, shards, side)
        counts = counts[order]
        starts = run_starts(bucket)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
            own, slot = np.unique(context[s:e], return_inverse=True)
            words = run_starts(word[s:e])
            per_word = np.diff(np.r_[words, e - s])
            out.append(("request", int(bucket[s]), None, block, pack(deltas(ids[word[s:e][words]]), u32(per_word), deltas(np.r_[ids, START][own]), steps(slot), counts[s:e])))
        return rows_table(out).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, seq = 0, 0
        keys, docs, train, vocab = [], [], [], {}
        for b in batches:
            trains = b.column(2).to_pylist()
            for i in range(b.num_rows):
                words = tokenize(b.column(1)[i].as_py())
                docs.append(np.array([vocab.setdefault(w, len(vocab) + 1) for w in words], np.int32))
                keys.append(b.column(0).slice(i, 1))
                train.append(trains[i])
                size += len(words) + 1
                if size >= least:
                    yield close(seq, pa.concat_arrays(keys), docs, train, vocab)
                    seq, size, keys, docs, train, vocab = seq + 1, 0, [], [], [], {}
        if docs:
            yield close(seq, pa.concat_arrays(keys), docs, train, vocab)

    return run


def _ipc(keys: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([keys], names=["k"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


# -- seating --------------------------------------------------------------------------------------


class Seatings:
    """How the number of seatings of c customers at t tables under a discount (generalised Stirling numbers) grows with t.

    Exact for up to ``exact`` customers. Beyond, few tables of c customers grow like t (exact / c)^discount tables
    of ``exact`` customers (their limit law), and many by the saddle point of the generating function; tests
    measure the error (under 1 in 100 of the mean tables from discounts of 0.3 up).
    """

    def __init__(self, discount: float, exact: int = 1024) -> None:
        self.discount, self.exact = discount, exact
        t = np.arange(exact + 1)
        log = np.full((exact + 1, exact + 1), -np.inf)
        log[0, 0] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(exact):
                log[c + 1] = np.logaddexp(log[c] + np.log(np.maximum(c - discount * t, 0)), np.r_[-np.inf, log[c, :-1]])
            self.rises = np.diff(log, axis=1, prepend=-np.inf)
            self.smooth = log[exact, 1:] + np.cumsum(np.log(np.maximum(t[:-1], 1))) + t[:-1] * math.log(discount)

    def _limit(self, x: np.ndarray) -> np.ndarray:
        first, last = self.smooth[1] - self.smooth[0], self.smooth[-1] - self.smooth[-2]
        return np.interp(x, np.arange(1, self.exact + 1), self.smooth) + np.minimum(x - 1, 0) * first + np.maximum(x - self.exact, 0) * last

    def rise(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log of the seatings at t tables over those at t - 1, for 2 <= t <= c."""
        small = c <= self.exact
        if small.all():
            return self.rises[c, t]
        out = np.empty(len(c))
        out[small] = self.rises[c[small], t[small]]
        c, t = c[~small].astype(np.float64), t[~small].astype(np.float64)
        scale = (self.exact / c) ** self.discount
        rises = self._limit(t * scale) - self._limit((t - 1) * scale) - np.log((t - 1) * self.discount)
        dense = (t >= 16) & (t > 0.4 * self.discount**3 * c)
        rises[dense] = self._saddle(c[dense], t[dense]) - self._saddle(c[dense], t[dense] - 1) - np.log(t[dense])
        out[~small] = rises
        return out

    def _saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log of t! times the seatings: the c-th coefficient of ((1 - (1 - z)^d) / d)^t about its saddle point z, found by Newton's steps over x = log(1 - z)."""
        d = self.discount
        t = np.minimum(t, c * (1 - 1e-6))
        x = np.minimum(np.log(t * d / c) / (1 - d), -1e-6)
        for _ in range(12):
            y, yd = np.expm1(x), np.expm1(d * x)
            over = np.log(t * d / c) + np.log(-y) + (d - 1) * x - np.log(-yd)
            x = np.minimum(x - over / ((1 + y) / y + d - 1 - d * (1 + yd) / yd), x * 0.1)
        z, phi = -np.expm1(x), -np.expm1(d * x)
        spread = c * (1 + z * (1 - d) * np.exp(-x) - c / t)
        return t * np.log(phi / d) - c * np.log(z) - 0.5 * np.log(np.maximum(spread, 1e-9))


@lru_cache(maxsize=4)
def seatings(discount: float) -> Seatings:
    return Seatings(discount)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cell_keys(words: np.ndarray, contexts: np.ndarray, sweep: int) -> np.ndarray:
    """What the random numbers of a dish in a restaurant in a sweep depend on: nothing of how the work is dealt."""
    turn = np.uint64((sweep + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return mixed(mixed(words + turn) ^ contexts)


def gumbel(keys: np.ndarray, t: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        turned = keys + t.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    u = (mixed(turned) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / (1 << 53)))


def seat(customers: np.ndarray, parent: np.ndarray, others: np.ndarray | float, discount: float, keys: np.ndarray) -> np.ndarray:
    """Tables of dishes, each drawn given all else: t with the weight of all its seatings times that of t - 1 more tables, the i-th of them ``parent`` (probability of the dish) times concentration plus discounted tables (``others`` and i).

    Drawn by the largest weight with Gumbel noise of ``keys``; terms 30 below the best, past the mode, are left.
    Of many customers only tables about the mode are tried, ten deviations and 40 more to either side.
    """
    out = np.minimum(customers, 1).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    if not len(at):
        return out
    table_ = seatings(discount)
    c, k = customers[at].astype(np.int64), keys[at]
    rate = np.log(np.broadcast_to(parent, customers.shape)[at]) + math.log(discount)
    base = THETA / discount + np.broadcast_to(np.asarray(others, np.float64), customers.shape)[at] - 1

    def rise(i: np.ndarray, t: np.ndarray) -> np.ndarray:
        return table_.rise(c[i], t) + rate[i] + np.log(base[i] + t)

    chosen = np.ones(len(c), np.int64)
    big = np.flatnonzero(c > table_.exact)
    if len(big):
        a, b = np.ones(len(big), np.int64), c[big]
        while (a < b).any():  # the mode: the last t with a rise
            mid = (a + b + 1) // 2
            up = rise(big, np.maximum(mid, 2)) > 0
            a, b = np.where(up & (a < b), mid, a), np.where(up | (a >= b), b, mid - 1)
        wide = 40 + (10 * np.sqrt(a)).astype(np.int64)
        lo, hi = np.maximum(1, a - wide), np.minimum(c[big], a + wide)
        for part in np.array_split(np.arange(len(big)), -(-int((hi - lo + 1).sum()) // 500_000)):
            size = (hi - lo + 1)[part]
            first = np.cumsum(size) - size
            i = np.repeat(part, size)
            t = lo[i] + np.arange(len(i)) - np.repeat(first, size)
            up = rise(big[i], np.maximum(t, 2))
            up[first] = 0  # weights from the window's first term on
            total = np.cumsum(up)
            noisy = total - np.repeat(total[first], size) + gumbel(k[big[i]], t)
            best = np.repeat(np.maximum.reduceat(noisy, first), size) if len(first) else noisy
            chosen[big[i[noisy == best]]] = t[noisy == best]
    live = np.flatnonzero(c <= table_.exact)
    t, now, best = np.ones(len(live), np.int64), np.zeros(len(live)), np.zeros(len(c))
    best[live] = gumbel(k[live], t)
    while True:
        t = t + 1
        go = t <= c[live]
        live, t, now = live[go], t[go], now[go]
        if not len(live):
            break
        up = rise(live, t)
        now = now + up
        noisy = now + gumbel(k[live], t)
        better = noisy > best[live]
        best[live[better]], chosen[live[better]] = noisy[better], t[better]
        go = (up > 0) | (now > best[live] - 30)
        live, t, now = live[go], t[go], now[go]
    out[at] = chosen
    return out


# -- the model ------------------------------------------------------------------------------------


@dataclass
class Root:
    """The restaurant of all words after a sweep: customers, tables."""

    customers: int
    tables: int


@dataclass
class Model:
    """What all tasks share: discounts of previous words' restaurants and of the one of all words, training tokens, distinct words."""

    discount: float
    root_discount: float
    tokens: int
    vocabulary: int

    def probability(self, root: Root, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of words in the restaurant of all words, whose own parent is uniform over the vocabulary and one unknown word."""
        new = (THETA + self.root_discount * root.tables) / (self.vocabulary + 1)
        return (customers - self.root_discount * tables + new) / (THETA + root.customers)

    def seat_words(self, root: Root, ids: np.ndarray, customers: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of words in the restaurant of all words; ``root``: after the sweep before."""
        return seat(customers, np.float64(1 / (self.vocabulary + 1)), float(root.tables - 1), self.root_discount, cell_keys(ids, START + np.uint64(1), sweep))

    def seat_cells(self, root: Root, cells: Cells, tables: np.ndarray, of_context: np.ndarray, word_customers: np.ndarray, word_tables: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of words in the restaurants of previous words, given totals of which a cell's own tables (but the first, which it always has) are taken out."""
        own = word_customers[cells.word] - tables + 1
        p = self.probability(Root(root.customers, root.tables), own, np.minimum(word_tables[cells.word], own))
        p *= (THETA + root.customers) / (THETA + root.customers - tables + 1)
        return seat(cells.count, p, of_context[cells.slot] - tables, self.discount, cell_keys(cells.ids[cells.word], cells.contexts[cells.slot], sweep))


@dataclass
class Cells:
    """Cells of a bucket by word and previous word: word ids in order and context ids in order; each cell's place in both, and its training customers."""

    ids: np.ndarray
    contexts: np.ndarray
    word: np.ndarray
    slot: np.ndarray
    count: np.ndarray

    @staticmethod
    def merge(requests: list[bytes]) -> tuple[Cells, list[np.ndarray]]:
        """One set of cells from those of many blocks, and the place of each block's cells in it."""
        parts = [Cells.load(r) for r in requests]
        ids, contexts = (np.unique(np.concatenate([getattr(p, x) for p in parts])) for x in ("ids", "contexts"))
        keys = [np.searchsorted(ids, p.ids)[p.word] * len(contexts) + np.searchsorted(contexts, p.contexts)[p.slot] for p in parts]
        cells, where = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(where, weights=np.concatenate([p.count for p in parts]), minlength=len(cells)).astype(np.int64)
        return Cells(ids, contexts, cells // len(contexts), cells % len(contexts), count), np.split(where, np.cumsum([len(k) for k in keys])[:-1])

    def live(self) -> Cells:
        """Cells whose tables vary: those of two or more customers."""
        many = self.count > 1
        words, word = np.unique(self.word[many], return_inverse=True)
        slots, slot = np.unique(self.slot[many], return_inverse=True)
        return Cells(self.ids[words], self.contexts[slots], word, slot, self.count[many])

    def dump(self) -> bytes:
        return pack(deltas(self.ids), u32(np.bincount(self.word, minlength=len(self.ids))), deltas(self.contexts), steps(self.slot), u32(self.count))

    @staticmethod
    def load(payload: bytes) -> Cells:
        ids, per_word, contexts, slot, count = unpack(payload)
        return Cells(np.cumsum(ids), np.cumsum(contexts), np.repeat(np.arange(len(ids)), per_word), np.cumsum(slot, dtype=np.uint32).astype(np.int64), count.astype(np.int64))

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=x, minlength=len(self.ids)).astype(np.int64)

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, weights=x, minlength=len(self.contexts)).astype(np.int64)


def _merge_bucket(side: int):
    """Of a bucket's requests: its "model", where each block's cells are in it ("asked"), its "live" cells, what it tells the nodes of its contexts and words ("told": customers, tables, which are live), and "sums": cells of one and of two customers. Blocks' own rows pass through."""

    def run(group: pa.Table) -> pa.Table:
        bucket, blocks = group.column("bucket")[0].as_py(), group.column("block").to_pylist()
        if bucket < 0:
            return group
        cells, places = Cells.merge(group.column("payload").to_pylist())
        out: list[Row] = [("model", bucket, None, None, cells.dump())]
        out += [("asked", bucket, None, b, pack(steps(p))) for b, p in zip(blocks, places, strict=True)]
        live, ones = cells.live(), np.minimum(cells.count, 1)
        if len(live.count):
            out.append(("live", bucket, None, None, live.dump()))
        out.append(("told", bucket, bucket // side, None, pack(deltas(cells.contexts), u32(cells.by_context(cells.count)), u32(cells.by_context(ones)), np.isin(cells.contexts, live.contexts).view(np.uint8))))
        out.append(("told", bucket, side + bucket % side, None, pack(deltas(cells.ids), u32(cells.by_word(cells.count)), u32(cells.by_word(ones)), np.isin(cells.ids, live.ids).view(np.uint8))))
        return rows_table([*out, ("sums", bucket, None, None, pack(np.array([(cells.count == 1).sum(), (cells.count == 2).sum()])))])

    return run


def _first_totals(side: int):
    """A node's contexts or words over all buckets: "all" of them back to each bucket (customers, tables, which are live in any bucket), the "answer" of those live there, and of words the "node" (customers in the restaurant of all words) with "sums". The node keeps for itself a "watch" of a bucket's ids that are live anywhere."""

    def run(group: pa.Table) -> pa.Table:
        node, buckets = group.column("node")[0].as_py(), group.column("bucket").to_pylist()
        told = [unpack(p) for p in group.column("payload").to_pylist()]
        ids, where = np.unique(np.concatenate([np.cumsum(t[0]) for t in told]), return_inverse=True)
        customers, tables = (np.bincount(where, weights=np.concatenate([t[n] for t in told]), minlength=len(ids)).astype(np.int64) for n in (1, 2))
        live_anywhere = np.bincount(where, weights=np.concatenate([t[3] for t in told]), minlength=len(ids)) > 0
        out: list[Row] = []
        for bucket, t, p in zip(buckets, told, np.split(where, np.cumsum([len(t[0]) for t in told])[:-1]), strict=True):
            out.append(("all", bucket, node, None, pack(u32(customers[p]), u32(tables[p]), live_anywhere[p].view(np.uint8))))
            if (varies := live_anywhere[p]).any():
                out.append(("watch", bucket, node, None, pack(deltas(ids[p[varies]]))))
            if (live := t[3] > 0).any():
                out.append(("answer", bucket, node, None, pack(u32(tables[p[live]]), u32(np.minimum(tables[p[live]], 1)))))
        if node >= side:
            out.append(("node", None, node, None, pack(deltas(ids), u32(tables))))
            out.append(("sums", None, node, None, pack(np.array([customers.sum(), (customers > 0).sum(), tables.sum(), (tables == 1).sum(), (tables == 2).sum()]))))
        return rows_table(out)

    return run


def _parts(group: pa.Table) -> Iterator[tuple]:
    """(kind, node, sample, payload) of the rows of a bucket or a node."""
    names = group.column_names
    samples = group.column("sample").to_pylist() if "sample" in names else [None] * group.num_rows
    return zip(group.column("kind").to_pylist(), group.column("node").to_pylist(), samples, group.column("payload").to_pylist(), strict=True)


def _sweep(model: Model, root: Root, side: int, sweep: int):
    """Seat a bucket's live cells anew: their "state" (tables, and the contexts' tables at the start) and what the nodes are "told" (tables beyond one a cell)."""

    def run(group: pa.Table) -> pa.Table:
        bucket, state, of_context, of_word = group.column("bucket")[0].as_py(), None, None, None
        for kind, node, _, payload in _parts(group):
            if kind == "live":
                cells = Cells.load(payload)
            elif kind == "state":
                state = unpack(payload)
            elif node < side:
                of_context = unpack(payload)[0].astype(np.int64)
            else:
                of_word = [x.astype(np.int64) for x in unpack(payload)]
        tables, start = (state[0].astype(np.int64), state[1]) if state else (np.ones(len(cells.count), np.int64), u32(of_context))
        tables = model.seat_cells(root, cells, tables, of_context, *of_word, sweep)
        return rows_table(
            [
                ("state", bucket, None, None, pack(u32(tables), start)),
                ("told", bucket, bucket // side, None, pack(deltas(cells.contexts), u32(cells.by_context(tables - 1)), start)),
                ("told", bucket, side + bucket % side, None, pack(deltas(cells.ids), u32(cells.by_word(tables - 1)))),
            ]
        )

    return run


def _totals(model: Model, root: Root, side: int, sweep: int):
    """A node's totals after a sweep: the "answer" to each bucket (tables of contexts; customers and tables of words in the restaurant of all words, seated anew here) on its live cells, "final" ones on all that a watch names, and "sums" of that restaurant."""

    def run(group: pa.Table) -> pa.Table:
        node = group.column("node")[0].as_py()
        rows = list(zip(group.column("kind").to_pylist(), group.column("bucket").to_pylist(), group.column("payload").to_pylist(), strict=True))
        told = [(b, unpack(p)) for kind, b, p in rows if kind == "told"]
        asked = [("answer", b, np.cumsum(t[0])) for b, t in told]
        asked += [("final", b, np.cumsum(unpack(p)[0])) for kind, b, p in rows if kind == "watch"]
        out: list[Row] = []
        if node < side:
            every, where = np.unique(np.concatenate([ids for *_, ids in asked[: len(told)]]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            total[where] = np.concatenate([t[2] for _, t in told])
            total += np.bincount(where, weights=np.concatenate([t[1] for _, t in told]), minlength=len(every)).astype(np.int64)
            values = [total]
        else:
            every, start = unpack(next(p for kind, _, p in rows if kind == "node"))
            every, customers = np.cumsum(every), start.astype(np.int64)
            for (_, t), (*_, ids) in zip(told, asked, strict=False):
                customers[np.searchsorted(every, ids)] += t[1]
            tables = model.seat_words(root, every, customers, sweep)
            values = [customers, tables]
            out.append(("sums", None, node, None, pack(np.array([customers.sum(), tables.sum()]))))
        for kind, bucket, ids in asked:
            p = np.searchsorted(every, ids)
            out.append((kind, bucket, node, None, pack(*(u32(v[p]) for v in values))))
        return rows_table(out)

    return run


def predictive(model: Model, cells: Cells, tables: np.ndarray, context: tuple[np.ndarray, np.ndarray], p: np.ndarray) -> np.ndarray:
    """Probability of each cell's word after its context, whose restaurant has ``context`` (customers, tables); ``p``: of words in the restaurant of all words."""
    customers, all_tables = context
    return (cells.count - model.discount * tables + (THETA + model.discount * all_tables[cells.slot]) * p[cells.word]) / (THETA + customers[cells.slot])


def _respond(model: Model, roots: list[Root], kept: list[int], side: int):
    """"response" to each block: log10 of the probabilities, averaged over the ``kept`` sweeps, of the cells it asked for, and training counts of its words. ``roots``: after each sweep, that before the first included."""

    def run(group: pa.Table) -> pa.Table:
        bucket, states, finals, every = group.column("bucket")[0].as_py(), {}, {}, {}
        asked: list[tuple[str, bytes]] = []
        for (kind, node, sample, payload), block in zip(_parts(group), group.column("block").to_pylist(), strict=True):
            if kind == "model":
                cells = Cells.load(payload)
            elif kind == "asked":
                asked.append((block, payload))
            elif kind == "state":
                states[sample] = unpack(payload)[0]
            elif kind == "final":
                finals[sample, node >= side] = [x.astype(np.int64) for x in unpack(payload)]
            else:
                every[node >= side] = [x.astype(np.int64) for x in unpack(payload)]
        customers, first_tables, contexts_vary = every[False]
        known, first_customers, words_vary = every[True]
        many, fixed, varies = cells.count > 1, words_vary == 0, words_vary > 0
        total = np.zeros(len(cells.count))
        for sweep in kept:
            tables, of_context, of_word, seated = np.minimum(cells.count, 1), first_tables.copy(), first_customers.copy(), np.zeros_like(known)
            seated[fixed] = model.seat_words(roots[sweep - 1], cells.ids[fixed], of_word[fixed], sweep)
            if many.any():
                tables[many] = states[sweep]
            if varies.any():
                of_word[varies], seated[varies] = finals[sweep, True]
            if contexts_vary.any():
                of_context[contexts_vary > 0] = finals[sweep, False][0]
            total += predictive(model, cells, tables, (customers, of_context), model.probability(roots[sweep], of_word, seated))
        logs = np.log10(total / len(kept)).astype(np.float32)
        out: list[Row] = []
        for block, payload in asked:
            places = np.cumsum(unpack(payload)[0], dtype=np.uint32)
            words = cells.word[places]
            out.append(("response", bucket, None, block, pack(logs[places], u32(known[words[run_starts(words)]]))))
        return rows_table(out)

    return run


def _sums(rows: DataFrame) -> np.ndarray:
    """Sums of the "sums" rows, one per bucket or node of a few numbers each."""
    found = [unpack(r["payload"])[0] for r in rows.where("kind = 'sums'").select("payload").collect()]
    return np.sum(found, axis=0) if found else np.zeros(5, np.int64)


def _of(rows: DataFrame, *kinds: str, sample: int | None = None) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds)).select("kind", "bucket", "node", "block", "payload", F.lit(sample).cast("int").alias("sample"))


def fit_and_respond(blocks: DataFrame, side: int, burn: int = 2, samples: int = 3) -> tuple[DataFrame, Model]:
    """Blocks' own rows with the responses to their requests, and the model. All is dealt over a grid: buckets by context shard and word shard, ``side`` of each, and a node for each shard, where totals over its buckets meet."""
    merged = materialize(blocks.groupBy("bucket").applyInArrow(_merge_bucket(side), ROW), by="kind")
    free_shuffles(merged)
    first = materialize(merged.where("kind = 'told'").groupBy("node").applyInArrow(_first_totals(side), ROW), by="kind")
    discard(merged, part="kind=told")
    once, twice = _sums(merged)[:2]
    tokens, vocabulary, customers, once_, twice_ = _sums(first)
    share = lambda a, b: float(np.clip(a / max(a + 2 * b, 1), 0.1, 0.95))
    model = Model(share(once, twice), share(once_, twice_), int(tokens), int(vocabulary))
    roots = [Root(int(customers), int(vocabulary))]
    live, answers, states, kept = _of(merged, "live"), first, None, []
    for sweep in range(1, burn + samples + 1):
        rows = live.unionByName(_of(answers, "answer"))
        rows = rows if states is None else rows.unionByName(_of(states, "state"))
        seated = materialize(rows.groupBy("bucket").applyInArrow(_sweep(model, roots[-1], side, sweep), ROW), by="kind")
        nodes = _of(first, "node") if sweep <= burn else _of(first, "node", "watch")
        told = nodes.unionByName(_of(seated, "told")).groupBy("node").applyInArrow(_totals(model, roots[-1], side, sweep), ROW)
        now = materialize(told, by="kind")
        discard(seated, part="kind=told")
        customers, tables = _sums(now)[:2]
        roots.append(Root(int(customers), int(tables)))
        if 1 < sweep <= burn + 1:  # what came before is needed no more
            discard(states, answers)
        states, answers = seated, now
        if sweep > burn:
            kept.append(sweep)
            live_rows = _of(states, "state", sample=sweep).unionByName(_of(answers, "final", sample=sweep))
            given = live_rows if sweep == burn + 1 else given.unionByName(live_rows)
        del rows, told, seated, now, nodes
        free_shuffles(merged)
    for rows, kinds in ((merged, ("live",)), (first, ("node", "watch", "answer"))):
        for kind in kinds:
            discard(rows, part=f"kind={kind}")
    rows = _of(merged, "model", "asked").unionByName(_of(first, "all")).unionByName(given)
    responses = rows.groupBy("bucket").applyInArrow(_respond(model, roots, kept, side), ROW)
    return merged.where("kind = 'own'").unionByName(responses, allowMissingColumns=True), model


def score_texts(docs: DataFrame, train: str, key: str = "doc_id", text: str = "text", side: int | None = None, burn: int = 2, samples: int = 3, block: int = BLOCK) -> DataFrame:
    """(``key``, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row of ``docs``.

    ``train``: a boolean column (null: false) of the rows to learn from. Tokens are lower-cased (A-Z) words and one
    end per text; null text has the end alone. Each previous word is a restaurant of its own; all share the
    restaurant of all words, whose parent is uniform over the vocabulary and one unknown word. Blocks of whole
    documents are counted first and ask for their (previous word, word) cells. Cells lie in a grid of ``side``
    shards of contexts by ``side`` of words, so that neither a common word nor a common context is in one
    task. Each sweep seats all customers of every cell anew, given totals of the sweep before (a cell's own
    taken out); then totals of contexts and words meet in nodes, one per shard, the words are seated in their
    parent there, and all goes back to the grid. Random numbers depend on words and sweep alone, so scores do
    not on how the work is dealt. ``score`` is the log10 of the predictive probabilities, averaged over
    ``samples`` sweeps after ``burn``, summed. A text must fit a task, as must a block of ``block`` tokens. Repeated
    rows are scored (and learnt) each; an empty table gives no rows; other columns are ignored. Read ``docs``
    from a table: where a task tried again gets its rows in another order, the blocks' parts don't meet and the
    query fails.
    """
    spark = docs.sparkSession
    side = side or math.ceil(math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col(key), F.col(text).cast("binary").alias("__text"), F.coalesce(F.col(train), F.lit(False)).alias("__train"))
    answered, model = fit_and_respond(rows.mapInArrow(_count_blocks(side, block), ROW), side, burn, samples)
    schema = docs.select(key).schema
    for f in spark.createDataFrame([], "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").schema:
        schema = schema.add(f)
    return answered.groupBy("block").applyInArrow(_finish(model, side, schema.names), schema)


def _finish(model: Model, side: int, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        buckets, payloads = group.column("bucket").to_pylist(), group.column("payload").to_pylist()
        rank, common, shards, lengths, raw = unpack(payloads[group.column("kind").to_pylist().index("own")])
        tokens, lengths = common.astype(np.int32)[rank], lengths.astype(np.int64)
        cells, where = distinct(cell_numbers(tokens, lengths, len(shards)))
        word, _, bucket, order = by_bucket(cells, shards.astype(np.int64), side)
        if len(run_starts(bucket)) != len(buckets) - 1:
            raise ValueError("parts of a block are missing: the rows of the input came in another order when a task was tried again")
        parts = [unpack(p) for b, p in sorted((b, p) for b, p in zip(buckets, payloads, strict=True) if b >= 0)]
        logs, known = np.empty(len(cells)), np.zeros(len(shards))
        logs[order] = np.concatenate([p[0] for p in parts])
        known[word[run_starts(bucket, word)]] = np.concatenate([p[1] for p in parts])
        base = np.log10((known + 1) / (model.tokens + model.vocabulary + 1))
        sums = [np.zeros(len(lengths)) for _ in range(3)]
        ends = np.cumsum(lengths)
        at = 0
        while at < len(lengths):  # documents of about half a million tokens at once
            first = ends[at] - lengths[at]
            to = max(at + 1, int(np.searchsorted(ends, first + 500_000, side="right")))
            some = slice(int(first), int(ends[to - 1]))
            starts = (ends - lengths)[at:to] - first
            for out, x in zip(sums, (known[tokens[some]] > 0, base[tokens[some]], logs[where[some]]), strict=True):
                out[at:to] = np.add.reduceat(x.astype(np.float64), starts)
            at = to
        keys = pa.ipc.open_stream(raw.tobytes()).read_all().column(0).combine_chunks()
        columns = [lengths, sums[0].astype(np.int64), np.full(len(lengths), model.tokens, np.int64), *sums[1:], 10 ** (-sums[2] / lengths)]
        return pa.table([keys, *map(pa.array, columns)], names=names)

    return run


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; those whose crc32(doc_id) mod 7 is 2 are held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("train"))
    return score_texts(docs, "train").select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
