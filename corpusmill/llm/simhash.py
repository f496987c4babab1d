"""Operator 1: SimHash near-dedup over a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, materialize, table

BITS, SEED, FAN, CHUNK, BATCH = 64, 42, 16, 4096, 4096


# -- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """SimHash of one UTF-8 text: a bit is 1 if set in over half of the shingles' XXH64; 0 without words."""
    words = (text or b"").lower().split()  # for bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip((ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    h, votes = np.array(hashes, dtype="<u8"), np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        votes += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, extra: Column | None = None) -> DataFrame:
    """(``key``, ``extra`` if given, fp long) for each row; null text has no words, so fingerprint 0."""
    more = [] if extra is None else [extra.alias("extra")]
    rows = docs.select(F.col(text).cast("binary").alias("__text"), F.col(key), *more)
    schema = rows.select(*rows.columns[1:], F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(0)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- the index ------------------------------------------------------------------------------------


def add_gray_rank(df: DataFrame, bits: str, out: str) -> DataFrame:
    """Place of a bit string in Gray order; one column per step, as each uses the one before twice."""
    df = df.withColumn(out, F.col(bits))
    for shift in (1, 2, 4, 8, 16, 32):
        df = df.withColumn(out, F.col(out).bitwiseXOR(F.shiftrightunsigned(out, shift)))
    return df


def layouts(distance: int, n: int) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """(key blocks, other blocks) of each table, blocks as (offset, bits).

    Fingerprints within ``distance`` agree on some choice of all but ``distance`` of the blocks, so every
    link is in at least one table. More blocks give longer keys; their number follows the count of
    distinct fingerprints, so that a key has about CHUNK of them or fewer at any size.
    """
    blocks = next((r for r in range(distance + 1, distance + 4) if n <= CHUNK << (BITS * (r - distance) // r)), distance + 4)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [([parts[i] for i in c], [p for i, p in enumerate(parts) if i not in c]) for c in combinations(range(blocks), blocks - distance)]


def gather(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    out, at = F.lit(0).cast("long"), 0
    for offset, bits in blocks:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << bits) - 1)), at))
        at += bits
    return out


class Index:
    """Fingerprints in Gray order under nodes of FAN children. A node's mask has the bits that all its fingerprints share, its pattern their values."""

    def __init__(self, fps: np.ndarray) -> None:
        self.levels = [(fps, fps)]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)))
        self.masks = [~(low ^ high) for low, high in self.levels]
        self.patterns = [low for low, _ in self.levels]


class Forest:
    """Labels of items that links have joined; ``edges`` is a spanning forest of label pairs."""

    def __init__(self, n: int) -> None:
        self.label, self.edges = np.arange(n), []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        differ = a != b
        if not differ.any():
            return
        pairs = np.unique(np.stack([np.minimum(a, b)[differ], np.maximum(a, b)[differ]], axis=1), axis=0)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y in pairs.tolist():
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                self.edges.append((min(rx, ry), max(rx, ry)))
        table_ = np.arange(len(self.label))
        for x in list(parent):
            table_[x] = root(x)
        self.label = table_[self.label]


def link(left: Index, right: Index, forest: Forest, distance: int, same: bool) -> None:
    """Join in ``forest`` the items of two indexes that differ in at most ``distance`` bits.

    Pairs of nodes are walked from the top; each carries the differences found in bits shared above, adds
    those in bits newly shared, and goes with its whole group once they exceed ``distance``. Right items are
    numbered after the left ones. Pairs of nodes whose items are all joined already are skipped.
    """
    shift = 0 if same else len(left.levels[0][0])
    top = max(len(left.levels), len(right.levels)) - 1
    li, ri = min(top, len(left.levels) - 1), min(top, len(right.levels) - 1)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    diff = (left.patterns[li][i] ^ right.patterns[ri][j]) & left.masks[li][i] & right.masks[ri][j]
    acc = np.bitwise_count(diff).astype(np.int64)
    todo = [(li, ri, i[acc <= distance], j[acc <= distance], acc[acc <= distance])]
    while todo:
        li, ri, i, j, acc = todo.pop()
        if len(i) > BATCH:
            todo.append((li, ri, i[BATCH:], j[BATCH:], acc[BATCH:]))
            i, j, acc = i[:BATCH], j[:BATCH], acc[:BATCH]
        if not len(i):
            continue
        if li == ri == 0:
            forest.join(i, j + shift)
            continue
        if max(li, ri) == 1:
            first, last = _span(forest, left, li, 0), _span(forest, right, ri, shift)
            open_ = ~((first[0][i] == first[1][i]) & (last[0][j] == last[1][j]) & (first[0][i] == last[0][j]))
            i, j, acc = i[open_], j[open_], acc[open_]
        down = lambda x, level: (x[:, None] * FAN + np.arange(FAN) if level else x[:, None])
        a, b = down(i, li), down(j, ri)
        known = left.masks[li][i] & right.masks[ri][j]
        reps = (len(i), a.shape[1], b.shape[1])
        a, b = np.broadcast_to(a[:, :, None], reps).ravel(), np.broadcast_to(b[:, None, :], reps).ravel()
        known, acc = np.repeat(known, reps[1] * reps[2]), np.repeat(acc, reps[1] * reps[2])
        li, ri = max(li - 1, 0), max(ri - 1, 0)
        there = (a < len(left.masks[li])) & (b < len(right.masks[ri]))
        if same:
            there &= a < b if li == 0 else a <= b
        a, b, known, acc = a[there], b[there], known[there], acc[there]
        new = left.masks[li][a] & right.masks[ri][b] & ~known
        acc = acc + np.bitwise_count((left.patterns[li][a] ^ right.patterns[ri][b]) & new)
        near = acc <= distance
        todo.append((li, ri, a[near], b[near], acc[near]))


def _span(forest: Forest, index: Index, level: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest label under each node of level 0 or 1."""
    labels = forest.label[shift : shift + len(index.levels[0][0])]
    if level == 0:
        return labels, labels
    at = np.arange(0, len(labels), FAN)
    return np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)


#: Links (a, b), or a chunk (its place in the order of partitions, and the bits that all or any of its items have).
LINKS = "a long, b long, tab int, key long, place long, low long, high long, fps binary"
PARTS, SEQS = 24, 28  # bits of a chunk's place: its partition, and its number there


def _link_rows(fps: np.ndarray, forest: Forest) -> pa.RecordBatch | None:
    if not forest.edges:
        return None
    e = np.array(forest.edges)
    n = len(e)
    nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(fps[e[:, 0]].view(np.int64)), pa.array(fps[e[:, 1]].view(np.int64)), *nothing], names=_NAMES)


_NAMES = [x.split()[0] for x in LINKS.split(", ")]


def _index_runs(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input sorted by tab, key and Gray rank. Runs of one key are cut into chunks; each is linked within, and its node goes out if its key may go on in another chunk."""
        part, seq = TaskContext.get().partitionId(), 0
        held_key, held, first = None, [], True

        def flush(key, fps, may_go_on):
            nonlocal seq
            index, forest = Index(fps), Forest(len(fps))
            link(index, index, forest, distance, True)
            if (rows := _link_rows(fps, forest)) is not None:
                yield rows
            if may_go_on:
                seq += 1
                signed = lambda x: int(np.uint64(x).view(np.int64))
                low, high = (x[0] for x in index.levels[-1])
                values = [None, None, key[0], key[1], part << SEQS | seq, signed(low), signed(high), fps.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_NAMES)

        cut = False  # the run in hand has been cut before
        for b in batches:
            tab, key, fp = (b.column(c).to_numpy() for c in range(3))
            if not len(tab):
                continue
            starts = np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(tab)], strict=True):
                k = (int(tab[s]), int(key[s]))
                if k != held_key and held_key is not None:
                    yield from flush(held_key, np.concatenate(held), first or cut)
                    held, first, cut = [], False, False
                held_key = k
                held.append(fp[s:e].view(np.uint64))
                while sum(map(len, held)) > CHUNK:
                    fps = np.concatenate(held)
                    yield from flush(k, fps[:CHUNK], True)
                    held, cut = [fps[CHUNK:]], True
        if held_key is not None:
            yield from flush(held_key, np.concatenate(held), True)

    return run


def _link_chunks(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                fa, fb = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                forest = Forest(len(fa) + len(fb))
                link(Index(fa), Index(fb), forest, distance, False)
                if (rows := _link_rows(np.concatenate([fa, fb]), forest)) is not None:
                    yield rows

    return run


def hamming_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough to connect all that differ in at most ``distance`` bits.

    Each table keys fingerprints by some blocks of bits and range-partitions them by key and Gray rank of
    the rest, so that a hot key spreads over partitions. A partition indexes its sorted runs in chunks of
    CHUNK. Chunks of one key are the leaves of a tree above, which is walked from the top like that within.
    """
    tables = layouts(distance, fps.count())
    placed = F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), gather(F.col("fp"), k).alias("key"), gather(F.col("fp"), rest).alias("rest")) for t, (k, rest) in enumerate(tables)]))
    rows = add_gray_rank(fps.select("fp", placed.alias("p")).select("p.tab", "p.key", "fp", "p.rest"), "rest", "rank")
    out = materialize(rows.repartitionByRange("tab", "key", "rank").sortWithinPartitions("tab", "key", "rank").select("tab", "key", "fp").mapInArrow(_index_runs(distance), LINKS))
    nodes = out.where(F.col("place").isNotNull())
    pairs = near_chunks(nodes.select("tab", "key", "place", "low", "high"), distance)
    blobs = lambda s: nodes.select(F.col("place").alias(s), F.col("fps").alias(f"fps_{s}"))
    crossed = pairs.join(blobs("x"), "x").join(blobs("y"), "y").select("fps_x", "fps_y").mapInArrow(_link_chunks(distance), LINKS)
    return out.where(F.col("a").isNotNull()).select("a", "b").unionByName(crossed.select("a", "b"))


def near_chunks(nodes: DataFrame, distance: int) -> DataFrame:
    """(x, y): places x < y of the chunks of one key whose shared bits differ in at most ``distance``.

    Chunks that follow each other have a parent for each 16 places, and so on up to one node a key. Pairs are
    walked from the top; the children of a pair are paired only if its shared bits allow a link.
    """
    several = nodes.join(nodes.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["tab", "key"])
    # Places are cut to the bits in use, so that the tree is no higher than they need.
    most = several.agg(F.max(F.shiftright("place", SEQS)), F.max(F.col("place").bitwiseAND(F.lit((1 << SEQS) - 1)))).first()
    if most[0] is None:
        return nodes.select(F.col("place").alias("x"), F.col("place").alias("y")).limit(0)
    seq_bits = int(most[1]).bit_length()
    short = F.shiftleft(F.shiftright("place", SEQS), seq_bits).bitwiseOR(F.col("place").bitwiseAND(F.lit((1 << seq_bits) - 1)))
    levels = [materialize(several.select("tab", "key", short.alias("at"), "low", "high", "place"))]
    for _ in range(-(-(int(most[0]).bit_length() + seq_bits) // 4)):
        up = levels[-1].groupBy("tab", "key", F.shiftright("at", 4).alias("at")).agg(F.bit_and("low").alias("low"), F.bit_or("high").alias("high"))
        levels.append(materialize(up))
    pairs = levels[-1].select("tab", "key", F.col("at").alias("x"), F.col("at").alias("y"))
    for level in reversed(levels[:-1]):
        sides = [level.select("tab", "key", F.shiftright("at", 4).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in level.columns[2:]]) for s in "xy"]
        both = pairs.join(sides[0], ["tab", "key", "x"]).join(sides[1], ["tab", "key", "y"])
        shared = F.bitwise_not(F.col("low_x").bitwiseXOR(F.col("high_x"))).bitwiseAND(F.bitwise_not(F.col("low_y").bitwiseXOR(F.col("high_y"))))
        apart = F.bit_count(F.col("low_x").bitwiseXOR(F.col("low_y")).bitwiseAND(shared))
        near = both.where((F.col("at_x") <= F.col("at_y")) & (apart <= distance))
        pairs = near.select("tab", "key", *[F.col(f"at_{s}").alias(s) for s in "xy"], *[F.col(f"place_{s}") for s in "xy" if "place" in level.columns])
    return pairs.where("x < y").select(F.col("place_x").alias("x"), F.col("place_y").alias("y"))


def join_hot(big: DataFrame, per_key: DataFrame, key: str, rows: int) -> DataFrame:
    """Join ``big``, of ``rows`` rows, with ``per_key``: one row per key, with ``n``, its number of rows of ``big``.

    Keys of more than a partition's share of the rows are fewer than partitions, so they are broadcast, and no
    task gets all rows of one.
    """
    share = max(1000, rows // int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(per_key.where(F.col("n") > share))
    rest = big.join(hot.select(key), key, "left_anti").join(per_key.where(F.col("n") <= share), key)
    return big.join(hot, key).unionByName(rest).drop("n")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); root is the least node reachable.

    Large-star and small-star in turn, written to the shared folder after each round, until nothing changes,
    however many rounds that takes (the stars' sizes grow with each). Centres of many edges are joined by broadcast.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = materialize(join_hot(both, least, "u", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, lowest, "u", now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(e, large)
        e = after
    leaves = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4, extra: Column | None = None) -> DataFrame:
    """(``key``, ``extra`` if given, fp, root, component_id) for each row: rows whose fingerprints are linked share root (the least linked fingerprint) and component_id (the least key).

    Texts are read whole. Null or empty texts have fingerprint 0, linked like any other. Rows with a null key
    count as members; component_id is null only if no row of the component has a key. Equal fingerprints are
    one item of the index, so that groups of exact copies of any size cost one row each. Repeated rows stay;
    an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(simhash(docs, key, text, width, extra))
    distinct = materialize(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = materialize(connected_components(hamming_links(distinct.select("fp"), distance)))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = materialize(linked)
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    by_fp = join_hot(linked.select("fp", "root"), named, "root", linked.count())
    return rows.join(by_fp, "fp").select(*[c for c in rows.columns if c != "fp"], "fp", "root", "component_id")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all ``documents``."""
    out = near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def brute_components(fps: dict[int, int], distance: int = 4) -> dict[int, int]:
    """For tests: component of each id by comparing all pairs."""
    ids, parent = sorted(fps), {i: i for i in fps}

    def root(x: int) -> int:
        return x if parent[x] == x else root(parent[x])

    values = np.array([fps[i] for i in ids], np.uint64)
    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(values[n + 1 :] ^ values[n]) <= distance).tolist():
            a, b = root(i), root(ids[n + 1 + m])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def kept_of_groups(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each component of ``near_dedup``: that of the least key (any one where none has a key)."""
    return judged.where(F.col(key).eqNullSafe(F.col("component_id"))).dropDuplicates([key, "root"])

