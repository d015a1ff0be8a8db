"""SimHash near-duplicates by the generalised pigeonhole principle.

64 fingerprint bits are grouped into partitions of correlated bits. For fingerprints within
``max_bits`` of each other, thresholds t_i with sum(t_i + 1) = max_bits + 1 leave at least one
partition in which they differ by t_i bits or fewer, so a fingerprint that probes, in each
partition, all values within t_i of its own meets every partner. The t_i are unequal and differ
by fingerprint: dynamic programming takes those with the least probes and estimated candidates.

Where links also need a similarity of the shingle sets, the same search makes the candidates. Pairs
of that similarity that lie further apart than it reaches are found by MinHash bands after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .graph import connected_components

BITS = 64
#: No partition gets a larger threshold than this: its ball of values would be too large to probe.
MOST = 3
#: Sub-blocks of a partition, over which counts are kept, have so many bits at most.
BLOCK = 11
#: Cost of a probe against that of a candidate.
PROBE_COST = 30.0
#: Columns of a shingle set's sketch: the set's size, then the parities of its hashes by their low 8 bits.
SKETCH = ("n", "b0", "b1", "b2", "b3")
#: MinHash bands and values in each: sets at a Jaccard similarity of 0.8 share a band with a probability of 1 - (1 - 0.8^5)^24 = 0.9999.
BANDS, VALUES = 24, 5
#: Bits that the search by fingerprints reaches where links need a similarity and may lie at any distance.
SEARCHED = 9
#: Odd multipliers, by which the shingle hashes take another order for each MinHash value.
ORDERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes | None, words: int) -> bytes:
    """XXH64 (seed 42, 8 bytes each, most significant first) of the shingles of ``text``, repeats included."""
    parts = text.lower().split() if text else []
    if not parts:
        return b""
    joined = b" ".join(parts)
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        return digest(joined, 42)
    ends = list(accumulate(map(len, parts), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(parts) - words])]
    return b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])])


def fingerprint(text: bytes | None, words: int) -> int:
    return majority(shingle_hashes(text, words))


def majority(hashes: bytes) -> int:
    """Bits that more than half of the hashes have; 0 without hashes."""
    if not hashes:
        return 0
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), 1 << 14):
        counts += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(rows)).view(">i8")[0])


def shingle_set(hashes: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(hashes, ">u8")).view(np.int64) if hashes else np.zeros(0, np.int64)


def sketch(hashes: bytes) -> np.ndarray:
    """The values of SKETCH.

    Where two sketches' parities differ, the sets differ by a shingle at least, so the number of
    differing bits is never above that of shingles in one set only.
    """
    own = shingle_set(hashes)
    parity = np.bincount(own & 255, minlength=256) & 1
    return np.r_[len(own), np.packbits(parity.astype(np.uint8)).view(">i8").astype(np.int64)]


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each MinHash band of a shingle set; none for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(len(ORDERS), ~np.uint64(0))
    for at in range(0, len(own), 1 << 11):
        np.minimum(low, (ORDERS[:, None] * own[at : at + (1 << 11)].view(np.uint64)).min(1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for value in low.reshape(BANDS, VALUES).T:
        key = (key ^ value) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def node_of(hashes: bytes) -> int:
    """XXH64 of the sorted shingle set: texts with equal sets are one node in the search for similar ones."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingle_set(hashes).tobytes(), 42)).view(np.int64))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", sketched: bool = False) -> DataFrame:
    """(doc_id, same, fp) for each row: the text's xxhash64 and the fingerprint as a signed long; if ``sketched``, also node, the columns of SKETCH and bands."""
    small_batches(docs.sparkSession)
    more = ("node", *SKETCH) if sketched else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keys = np.zeros((batch.num_rows, 1 + len(more)), np.int64), []
            for row, t in zip(out, batch.column(1)):
                hashes = shingle_hashes(t.as_py(), words)
                row[0] = majority(hashes)
                if more:
                    row[1], row[2:] = node_of(hashes), sketch(hashes)
                    keys.append(bands(shingle_set(hashes)))
            held = [pa.array(keys, pa.list_(pa.int64()))] if more else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in out.T.copy()), *held], names=["doc_id", "same", "fp", *more, *(["bands"] if more else [])])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("same"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "same", "fp", *more)) + (", bands array<long>" if more else ""))


# ---------------------------------------------------------------- partitions and thresholds


@dataclass(frozen=True)
class Layout:
    """Bits of each partition, each split into sub-blocks."""

    parts: tuple[tuple[int, ...], ...]

    def blocks(self) -> list[list[tuple[int, ...]]]:
        out = []
        for bits in self.parts:
            n = -(-len(bits) // BLOCK)
            out.append([tuple(bits[k] for k in x) for x in np.array_split(np.arange(len(bits)), n)])
        return out


def take_bits(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """Those bits of each fingerprint as a number, the first one lowest."""
    fps, out = fps.view(np.uint64), np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def bit_correlation(fps: DataFrame) -> np.ndarray:
    """Correlation of all bit pairs over all fingerprints; the driver gets 64 x 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = np.unpackbits(_numbers(batch).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i * BITS + j), pa.array(total[i, j])], names=["at", "n"])

    both = np.zeros(BITS * BITS)
    for at, n in fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        both[at] = n
    both = both.reshape(BITS, BITS)
    both = both + np.triu(both, 1).T
    count = max(1, fps.count())
    mean = np.diag(both) / count
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return (both / count - np.outer(mean, mean)) / np.outer(spread, spread)


def group_bits(corr: np.ndarray, m: int) -> Layout:
    """m partitions of near-equal width; each grows by the bit most correlated with those it has."""
    strength, left, parts = np.abs(corr) - np.eye(BITS) * np.abs(corr), set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        order = sorted(left)
        own = [max(order, key=lambda b: (strength[b, order].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            own.append(max(sorted(left), key=lambda b: (strength[b, own].sum(), -b)))
            left.discard(own[-1])
        parts.append(tuple(sorted(own)))
    return Layout(tuple(parts))


def block_counts(fps: DataFrame, layouts: list[Layout]) -> list[list[list[np.ndarray]]]:
    """How many fingerprints have each value, by layout, partition and sub-block: all rows counted, at most 2^11 sums a block collected."""
    flat = [(a, b, c, bits) for a, lay in enumerate(layouts) for b, part in enumerate(lay.blocks()) for c, bits in enumerate(part)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << len(x[3]), np.int64) for x in flat]
        for batch in batches:
            v = _numbers(batch)
            for k, x in enumerate(flat):
                sums[k] += np.bincount(take_bits(v, x[3]), minlength=len(sums[k]))
        for k, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(s[at])], names=["k", "v", "n"])

    sums = [np.zeros(1 << len(x[3])) for x in flat]
    for k, v, n in fps.select("fp").mapInArrow(run, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n")).collect():
        sums[k][v] = n
    out: list[list[list[np.ndarray]]] = [[[] for _ in lay.parts] for lay in layouts]
    for (a, b, _, _), s in zip(flat, sums):
        out[a][b].append(s)
    return out


def masks(width: int, d: int) -> np.ndarray:
    """Numbers of ``width`` bits with exactly d set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), d)], np.int64)


class Allocator:
    """Thresholds by dynamic programming on estimated candidate counts."""

    def __init__(self, layout: Layout, counts: list[list[np.ndarray]], max_bits: int):
        self.layout, self.max_bits = layout, max_bits
        self.total = max(1.0, counts[0][0].sum())
        #: shares[i][c][d][v]: the share of all fingerprints that differ from v in exactly d bits of that sub-block
        self.shares = []
        for bits, part in zip(layout.parts, counts):
            own = []
            for s in part:
                width, v = len(s).bit_length() - 1, np.arange(len(s))
                own.append([sum((s[v ^ x] for x in masks(width, d)), np.zeros(len(s))) / self.total for d in range(min(MOST, width) + 1)])
            self.shares.append(own)
        self.ball = [[sum(len(masks(len(bits), d)) for d in range(t + 1)) for t in range(MOST + 1)] for bits in layout.parts]

    def costs(self, fps: np.ndarray) -> list[np.ndarray]:
        """For each partition, rows of cost by threshold: -1 (none) to MOST."""
        out = []
        for i, blocks in enumerate(self.layout.blocks()):
            near = np.zeros((MOST + 1, len(fps)))
            near[0] = 1
            for c, bits in enumerate(blocks):
                v, then = take_bits(fps, bits), np.zeros_like(near)
                for d, share in enumerate(self.shares[i][c]):
                    then[d:] += near[: MOST + 1 - d] * share[v]
                near = then
            seen = np.cumsum(near, 0) * self.total
            out.append(np.vstack([np.zeros(len(fps)), *(PROBE_COST * self.ball[i][t] + seen[t] for t in range(MOST + 1))]))
        return out

    def thresholds(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(partitions x rows of thresholds, cost of each row); sum(t + 1) is max_bits + 1."""
        costs, need = self.costs(fps), self.max_bits + 1
        best = [np.where(np.arange(need + 1)[:, None] == 0, 0.0, np.inf) * np.ones(len(fps))]
        picks = []
        for cost in costs:
            now, pick = np.full((need + 1, len(fps)), np.inf), np.zeros((need + 1, len(fps)), np.int8)
            for s in range(MOST + 2):
                if s <= need:
                    cand = best[-1][: need + 1 - s] + cost[s]
                    better = cand < now[s:]
                    now[s:][better], pick[s:][better] = cand[better], s
            best.append(now)
            picks.append(pick)
        out, left = np.zeros((len(costs), len(fps)), np.int8), np.full(len(fps), need)
        for i in range(len(costs) - 1, -1, -1):
            s = picks[i][left, np.arange(len(fps))]
            out[i], left = s - 1, left - s
        return out, best[-1][need]


def plan(fps: DataFrame, max_bits: int) -> Allocator:
    """The number of partitions with the least estimated cost.

    The estimate is the mean over 1,024 fingerprints; it steers the work, never the links.
    """
    corr = bit_correlation(fps)
    least = -(-(max_bits + 1) // (MOST + 1))
    layouts = [group_bits(corr, m) for m in range(max(2, least), max(2, least) + 5)]
    some = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(1024).collect()], np.int64)
    found = [Allocator(lay, c, max_bits) for lay, c in zip(layouts, block_counts(fps, layouts))]
    return min(found, key=lambda a: float(a.thresholds(some)[1].mean()) if len(some) else 0.0)


# ---------------------------------------------------------------- links


def _keys(part: int, values: np.ndarray) -> np.ndarray:
    return values | np.int64(part) << np.int64(40)


def _longs(df: DataFrame, *more: str) -> str:
    return ", ".join(f"{c} long" for c in ("key", *df.columns, *more))


def index_rows(nodes: DataFrame, layout: Layout) -> DataFrame:
    """key and the columns of ``nodes`` (fp first, all long): one row for each fingerprint and partition; the key holds both the partition and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _numbers(batch)
            for i, bits in enumerate(layout.parts):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(i, take_bits(v, bits))), *batch.columns], names=["key", *batch.schema.names])

    return nodes.mapInArrow(run, _longs(nodes))


def probe_rows(nodes: DataFrame, allocator: Allocator) -> DataFrame:
    """key, the columns of ``nodes`` and ts: the values that each fingerprint probes under its own thresholds; ts packs those (t + 1 in 3 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _numbers(batch)
            t, _ = allocator.thresholds(v)
            ts = pa.array(sum((t[i].astype(np.int64) + 1) << np.int64(3 * i) for i in range(len(t))))
            for i, bits in enumerate(allocator.layout.parts):
                own = take_bits(v, bits)
                for d in range(MOST + 1):
                    at, flips = np.flatnonzero(t[i] >= d), masks(len(bits), d)
                    step = max(1, (1 << 18) // max(1, len(flips)))
                    for k in range(0, len(at), step):
                        some = at[k : k + step]
                        key = _keys(i, (own[some][:, None] ^ flips).ravel())
                        each = pa.array(np.repeat(some, len(flips)))
                        yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(each) for c in (*batch.columns, ts))], names=["key", *batch.schema.names, "ts"])

    return nodes.mapInArrow(run, _longs(nodes, "ts"))


def chain_edges(index: DataFrame, max_bits: int, lags: int = 6) -> DataFrame:
    """Links to the few rows before and to the first in a sorted bucket.

    At most ``lags + 1`` a row whatever a bucket's size; they join up dense groups, so that the
    exact search need not list pairs inside them. A link cut at a range boundary isn't lost: the
    exact search finds it.
    """
    ranged = index.repartitionByRange(F.col("key"), F.col("fp")).sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old_key = old_fp = np.zeros(0, np.int64)
        lead_key, lead_fp = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            all_key, all_fp = np.concatenate([old_key, key]), np.concatenate([old_fp, fp])
            n, a, b = len(old_key), [], []
            for lag in range(1, lags + 1):
                here = np.arange(max(n, lag), len(all_key))
                near = here[(all_key[here] == all_key[here - lag]) & (np.bitwise_count((all_fp[here] ^ all_fp[here - lag]).view(np.uint64)) <= max_bits)]
                a.append(all_fp[near])
                b.append(all_fp[near - lag])
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lead = fp[first].copy()
            if lead_key == key[0]:
                lead[0] = lead_fp
            leads = np.repeat(lead, np.diff(np.r_[first, len(key)]))
            near = np.flatnonzero((leads != fp) & (np.bitwise_count((leads ^ fp).view(np.uint64)) <= max_bits))
            a.append(fp[near])
            b.append(leads[near])
            lead_key, lead_fp = key[-1], lead[-1]
            old_key, old_fp = all_key[-lags:], all_fp[-lags:]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return ranged.select("key", "fp").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def cross_links(nodes: DataFrame, allocator: Allocator, name: str = "fp", also: Column | None = None) -> DataFrame:
    """(a, b, root_a, root_b): all pairs within max_bits whose roots differ, each once.

    ``name`` is the column that names a node; nodes may share a fingerprint. ``also`` is a further condition
    on the two rows (p_ and x_ before their columns). The distance is part of the join condition, so candidates never become rows; nor does a pair in
    any but the first partition where its probe reaches it. A bucket whose members all have the
    probe's root is left out before it is read.
    """
    index = index_rows(nodes, allocator.layout)
    probes = probe_rows(nodes, allocator)
    held = index.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    probes = probes.join(held, "key").where("root <> low or root <> high").drop("low", "high")
    p, x = (df.toDF(*(c if c == "key" else f"{side}_{c}" for c in df.columns)) for side, df in (("p", probes), ("x", index)))
    differ = p["p_fp"].bitwiseXOR(x["x_fp"])
    on = (p["key"] == x["key"]) & (p["p_root"] != x["x_root"]) & (p[f"p_{name}"] < x[f"x_{name}"]) & (F.bit_count(differ) <= allocator.max_bits)
    on = on if also is None else on & also
    for j, bits in enumerate(allocator.layout.parts[:-1]):
        mask = sum(1 << b for b in bits)
        mask = mask - (1 << 64) if mask >> 63 else mask
        reached = F.bit_count(differ.bitwiseAND(F.lit(mask).cast("long"))) < F.shiftright(p["p_ts"], 3 * j).bitwiseAND(F.lit(7).cast("long"))
        on = on & ((F.shiftright(p["key"], 40) <= j) | ~reached)
    return p.join(x, on).select(F.col(f"p_{name}").alias("a"), F.col(f"x_{name}").alias("b"), F.col("p_root").alias("root_a"), F.col("x_root").alias("root_b"))


def with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the root of each fingerprint's present root, if it has one."""
    on = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return nodes.join(on, "root", "left").withColumn("root", F.coalesce("top", "root")).select(nodes.columns)


def link_groups(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) of the fingerprints in ``fps``."""
    nodes = cut(fps.select("fp").distinct().withColumn("root", F.col("fp")), "fps")
    if nodes.isEmpty():
        return nodes
    allocator = plan(nodes, max_bits)
    near = chain_edges(index_rows(nodes.select("fp"), allocator.layout), max_bits)
    nodes = cut(with_roots(nodes, connected_components(near)), "nodes")
    links = cross_links(nodes, allocator)
    return with_roots(nodes, connected_components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))


# ---------------------------------------------------------------- links by similarity


def sketches_allow(least: float) -> Column:
    """Whether sizes and sketches leave a similarity of ``least`` possible, for rows p_ and x_.

    Sets A and B that similar differ by at most (1 - s) / (1 + s) (|A| + |B|) shingles.
    """
    unlike = sum((F.bit_count(F.col(f"p_{c}").bitwiseXOR(F.col(f"x_{c}"))) for c in SKETCH[1:]), F.lit(0))
    return (F.least("p_n", "x_n") >= least * F.greatest("p_n", "x_n") - 1e-6) & (unlike <= (1 - least) / (1 + least) * (F.col("p_n") + F.col("x_n")) + 1e-6)


def similar_chains(index: DataFrame, least: float, max_bits: int, lags: int = 6) -> DataFrame:
    """(a, b): candidates among neighbours in a sorted bucket, at most ``lags + 1`` a row whatever its size.

    index: key, node, fp and SKETCH, all long. They join up dense groups, as chain_edges does; what a
    range boundary cuts is found by cross_links.
    """
    columns = ["key", "node", "fp", *SKETCH]
    ranged = index.select(columns).repartitionByRange("key", "fp", "n", "node").sortWithinPartitions("key", "fp", "n", "node")
    apart = (1 - least) / (1 + least)

    def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m = x[:, 3], y[:, 3]
        unlike = np.bitwise_count((x[:, 4:] ^ y[:, 4:]).view(np.uint64)).sum(1)
        on = (x[:, 0] == y[:, 0]) & (x[:, 1] != y[:, 1]) & (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6) & (unlike <= apart * (n + m) + 1e-6)
        return on & (np.bitwise_count((x[:, 2] ^ y[:, 2]).view(np.uint64)) <= max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, lead = np.zeros((0, len(columns)), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([c.to_numpy() for c in batch.columns], 1)
            seen, found = np.concatenate([old, own]), []
            for lag in range(1, lags + 1):
                here = np.arange(max(len(old), lag), len(seen))
                found.append((seen[here], seen[here - lag]))
            first = np.flatnonzero(np.r_[True, own[1:, 0] != own[:-1, 0]])
            leads = own[first]
            if lead is not None and lead[0] == own[0, 0]:
                leads[0] = lead
            lead, old = leads[-1], seen[-lags:]
            found.append((own, np.repeat(leads, np.diff(np.r_[first, len(own)]), axis=0)))
            pairs = np.concatenate([np.stack([x[on, 1], y[on, 1]], 1) for x, y in found for on in (possible(x, y),)])
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["a", "b"])

    return ranged.mapInArrow(run, "a long, b long").distinct()


def band_pairs(rows: DataFrame, least: float, beyond: int) -> DataFrame:
    """(a, b, root_a, root_b): all pairs more than ``beyond`` bits apart that share a band, differ in root and that sizes and sketches don't rule out, each once.

    The bounds are part of the join condition, and buckets of one root are left out before they are
    read. So is every key but the smallest that a pair shares: a node's rows carry its keys, 24 at most.
    """
    held = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    more = [c for c in rows.columns if c not in ("key", "node")]
    rows = rows.join(held, "key").groupBy("node").agg(F.collect_set("key").alias("keys"), *(F.first(c).alias(c) for c in more))
    rows = rows.select(F.explode("keys").alias("key"), "keys", "node", *more)
    p, x = (rows.toDF(*(c if c == "key" else f"{side}_{c}" for c in rows.columns)) for side in ("p", "x"))
    on = (p["key"] == x["key"]) & (F.col("p_root") != F.col("x_root")) & (F.col("p_node") < F.col("x_node")) & sketches_allow(least)
    on = on & (F.bit_count(F.col("p_fp").bitwiseXOR(F.col("x_fp"))) > beyond)
    on = on & (F.array_min(F.array_intersect("p_keys", "x_keys")) == p["key"])
    return p.join(x, on).select(F.col("p_node").alias("a"), F.col("x_node").alias("b"), F.col("p_root").alias("root_a"), F.col("x_root").alias("root_b"))


def similar_groups(nodes: DataFrame, verify, least: float, max_bits: int | None) -> DataFrame:
    """(node, root) of ``nodes`` (node, fp, SKETCH, bands); verify(pairs a, b) keeps the pairs that are similar enough.

    All pairs within ``max_bits`` (SEARCHED, if None) are found by their fingerprints. If None, MinHash bands
    then find the pairs further apart.
    """
    if nodes.isEmpty():
        return nodes.select("node", F.col("node").alias("root"))
    allocator = plan(cut(nodes.select("fp").distinct(), "fps"), SEARCHED if max_bits is None else max_bits)

    def linked(at: DataFrame, links: DataFrame) -> DataFrame:
        edges = links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        return cut(with_roots(at, connected_components(edges)), "nodes")

    near = verify(similar_chains(index_rows(nodes.select("fp", "node", *SKETCH), allocator.layout), least, allocator.max_bits))
    nodes = linked(nodes.withColumn("root", F.col("node")), near.select("*", F.col("a").alias("root_a"), F.col("b").alias("root_b")))
    nodes = linked(nodes, verify(cross_links(nodes.select("fp", "node", *SKETCH, "root"), allocator, "node", sketches_allow(least))))
    if max_bits is None:
        rows = nodes.select(F.explode("bands").alias("key"), "node", "fp", *SKETCH, "root")
        nodes = linked(nodes, verify(band_pairs(rows, least, allocator.max_bits)))
    return nodes.select("node", "root")


def simhash_groups(docs: DataFrame, words: int = 4, max_bits: int | None = 4, id_col: str = "doc_id", text_col: str = "text", min_similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Rows whose fingerprints can be joined by steps of at most ``max_bits`` differing bits have the
    same component_id: its smallest doc_id. With ``min_similarity``, a step also needs that Jaccard
    similarity of the two shingle sets, whatever the fingerprints: only equal sets are one without
    a test. ``max_bits`` may then be None (any distance): pairs within SEARCHED bits are found by their
    fingerprints, and the similar pairs further apart by MinHash bands.
    Rows then also have ``same`` (xxhash64 of the text) and ``first``: whether their id and text are
    the component's smallest (null ids last), which is so of one id and text in each component.

    Null and blank texts have fingerprint 0 and an empty set, and link like any other. Null ids keep
    their row and never are a component_id unless the whole component has none (then null). Repeated
    rows and equal texts meet in one fingerprint or set. Extra columns are not read. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, words, id_col, text_col, min_similarity is not None), "doc-fps")
    if min_similarity is None:
        owners = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
        groups = cut(link_groups(fps, max_bits).join(owners, "fp"), "groups")
        smallest = groups.groupBy("root").agg(F.min("rep").alias("component_id"))
        return fps.join(groups.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")
    own = F.min_by(F.struct(rank.alias("rep"), "fp", *SKETCH, "bands"), rank)
    owners = cut(fps.groupBy("node").agg(own.alias("o")).select("node", "o.*"), "owners")
    verify = _verifier(docs, owners.select("node", F.col("rep.doc_id").alias("rep")), words, min_similarity, id_col, text_col)
    groups = cut(similar_groups(owners.drop("rep"), verify, min_similarity, max_bits).join(owners.select("node", "rep"), "node"), "groups")
    smallest = groups.groupBy("root").agg(F.min("rep").alias("rep"))
    first = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("same") == F.col("rep.same"))
    return fps.join(groups.drop("rep").join(smallest, "root").select("node", "rep"), "node").select("doc_id", "fp", F.col("rep.doc_id").alias("component_id"), "same", first.alias("first"))


def _verifier(docs: DataFrame, owners: DataFrame, words: int, least: float, id_col: str, text_col: str):
    """Keeps pairs whose shingle sets are similar enough, compared on the document that owns each node (node, rep)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), words) for t in batch.column(1)]
            own = pa.array([node_of(h) for h in hashes], pa.int64())
            found = pa.array([shingle_set(h) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), own, found], names=["node", "own", "shingles"])

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(owners, "node")
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
        shingles = wanted.join(texts, F.col("rep").eqNullSafe(F.col("doc_id"))).select("node", "text").mapInArrow(sets, "node long, own long, shingles array<long>")
        shingles = cut(shingles.where("node = own").drop("own").dropDuplicates(["node"]), "shingles")  # an id may have several texts
        one, two = shingles.toDF("a", "s"), shingles.toDF("b", "t")
        same = F.size(F.array_intersect("s", "t"))
        near = same >= least * (F.size("s") + F.size("t") - same)
        return cut(pairs.join(one, "a").join(two, "b").where(near).select(*pairs.columns), "verified")

    return verify
