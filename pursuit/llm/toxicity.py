"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, from a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, cut, in_sample, remove, small_batches

#: Fitting reads about so many labelled documents of each class, picked by the hash of their ids.
SAMPLE = 2000
#: Words are weighted by 1 + (z / TELLING)^2, z being the standard errors between their shares of toxic and of clean examples.
TELLING = 3.0
NEIGHBOURS = 25
BLOCK = 32
#: Blocks opened before the first cosine to beat is known; each further round opens four times as many.
FIRST = 8
#: Words that more than this share of the blocks have are stored as rows.
WIDE = 0.5
#: Equal texts of a task are scored once; so many results are kept at a time.
MEMO = 20000
#: Directions along which examples are dealt into blocks.
DIRECTIONS = 12
_WORDS = re.compile(r"[^\W\d_]+")


def word_counts(text: str | None) -> Counter:
    return Counter(_WORDS.findall(text.lower())) if text else Counter()


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, end), one after another."""
    size = ends - starts
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + size, size)


@dataclass(frozen=True)
class Index:
    """Inverted lists over unit example vectors, in blocks of BLOCK examples with each word's largest weight in each block.

    A word's list is a run of entries, one for each block that has the word (its block, its peak there
    and where its postings begin); an entry's postings are (example, weight). Equal vectors are stored
    once, with the number of examples that have them (n) and what these weigh in a vote, in all
    (mass) and the toxic ones alone (toxic). Words that WIDE of the blocks have are kept as rows over
    all blocks as well, which is how they are read.
    """

    words: dict[str, int]
    weight: np.ndarray  # of each word: idf x telling factor
    entries: np.ndarray  # where each word's entries begin
    block: np.ndarray
    peak: np.ndarray
    postings: np.ndarray  # where each entry's postings begin
    example: np.ndarray
    value: np.ndarray
    row: np.ndarray  # of each word: its row in the next two, or -1
    wide_peak: np.ndarray  # rows x blocks
    wide_value: np.ndarray  # (rows x blocks) x BLOCK
    n: np.ndarray
    mass: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    blank: float  # share of toxic votes among examples without words
    offset: float = 0.0
    scale: float = 1.0

    @property
    def lists(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each word: examples, weights and the blocks that have it."""
        out = []
        for a, b in zip(self.entries[:-1], self.entries[1:]):
            at = slice(self.postings[a], self.postings[b])
            out.append((self.example[at], self.value[at], self.block[a:b]))
        return out

    def code(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(known words, their counts), by word."""
        at = sorted((self.words[w], c) for w, c in counts.items() if w in self.words)
        return np.array([k for k, _ in at], np.int64), np.array([c for _, c in at], np.int64)

    def unit(self, k: np.ndarray, c: np.ndarray) -> np.ndarray:
        v = (1 + np.log(c)) * self.weight[k]
        return v / math.sqrt(float(v @ v)) if len(v) else v

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        k, c = self.code(counts)
        return k, self.unit(k, c)

    def search(self, k: np.ndarray, v: np.ndarray, neighbours: int = NEIGHBOURS, opened: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The vectors with the largest cosines that stand for ``neighbours`` examples at least, and all that tie with the last.

        Blocks are opened by falling bound (sum of weight x the word's peak there), until none is left
        whose bound reaches the last cosine needed. ``opened`` receives (blocks opened, blocks).
        """
        row, blocks = self.row[k], -(-len(self.n) // BLOCK)
        wide, w = row[row >= 0], v[row >= 0]
        k, v = k[row < 0], v[row < 0]
        entry, q = spans(self.entries[k], self.entries[k + 1]), np.repeat(v, self.entries[k + 1] - self.entries[k])
        block = self.block[entry]
        bound = w @ self.wide_peak[wide] + np.bincount(block, q * self.peak[entry], blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        cos, least, at, step = np.zeros(blocks * BLOCK), 0.0, 0, FIRST
        while at < len(order):
            some = order[at : at + step]
            some = some[bound[some] >= least - 1e-9]
            if not len(some):
                break
            at, step = at + len(some), step * 4
            if len(wide):
                cos.reshape(blocks, BLOCK)[some] += (w @ self.wide_value.take((wide[:, None] * blocks + some).ravel(), 0).reshape(len(wide), -1)).reshape(len(some), BLOCK)
            chosen = np.zeros(blocks, bool)
            chosen[some] = True
            here = chosen[block]
            own = entry[here]
            begin, end = self.postings[own], self.postings[own + 1]
            post = spans(begin, end)
            cos += np.bincount(self.example[post], np.repeat(q[here], end - begin) * self.value[post], len(cos))
            if neighbours <= at * BLOCK:  # a vector stands for one example at least, so no more of them are needed
                least = np.partition(cos, -neighbours)[-neighbours]
        best = np.flatnonzero((cos > 0) & (cos >= least - 1e-9))
        best = best[np.lexsort((best, -cos[best]))]
        reached = np.searchsorted(np.cumsum(self.n[best]), neighbours)
        if reached < len(best):
            best = best[cos[best] >= cos[best[reached]] - 1e-9]
        if opened is not None:
            opened.append((at, blocks))
        return best, cos[best]

    def vote(self, k: np.ndarray, c: np.ndarray) -> tuple[float, list[int]]:
        """Share of toxic votes, weighted by squared cosine, and the ids of the nearest examples."""
        if len(k):
            at, cos = self.search(k, self.unit(k, c))
            if len(at):
                weight = cos * cos
                return float((weight @ self.toxic[at]) / (weight @ self.mass[at])), [int(x) for x in self.ids[at[:3]]]
        return self.blank, []

    def score(self, k: np.ndarray, c: np.ndarray) -> tuple[float, list[int]]:
        share, near = self.vote(k, c)
        return 1 / (1 + math.exp(-(self.offset + self.scale * share))), near

    def without_itself(self, e: int, k: np.ndarray, v: np.ndarray, of: dict[int, float]) -> tuple[float, float]:
        """Shares of toxic votes near example e, once without a toxic and once without a clean one of its own examples; ``of``: what one of a class weighs."""
        at, cos = self.search(k, v, NEIGHBOURS + 1)
        own, weight, out = at == e, cos * cos, []
        for y in (1, 0):
            total = float(weight @ np.maximum(self.mass[at] - own * of[y], 0))
            out.append(float(weight @ np.maximum(self.toxic[at] - own * of[y] * y, 0)) / total if total > 0 else self.blank)
        return out[0], out[1]


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Factor of each word by the numbers of toxic and clean examples that have it. It is 1 at least, so no word is left out."""
    if not n_toxic or not n_clean:
        return np.ones(len(toxic))
    p = (toxic + clean) / (n_toxic + n_clean)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n_toxic + 1 / n_clean))
    return 1 + (np.abs(toxic / n_toxic - clean / n_clean) / spread / TELLING) ** 2


def dealt(starts: np.ndarray, word: np.ndarray, value: np.ndarray, n_words: int) -> np.ndarray:
    """Examples in an order that puts like ones into one block: halved again and again along the main directions of their vectors."""
    n = len(starts) - 1
    if n <= BLOCK:
        return np.arange(n)
    row = np.repeat(np.arange(n), np.diff(starts))

    def product(m: np.ndarray, at: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
        """The sparse matrix (or its transpose) times m, a column at a time to spare memory."""
        return np.stack([np.bincount(to, c[at] * value, size) for c in m.T], 1)

    x = np.random.default_rng(7).standard_normal((n, DIRECTIONS))
    for _ in range(4):
        x, _ = np.linalg.qr(x - x.mean(0))
        x = product(product(x, row, word, n_words), word, row, n)
    out, todo = [], [np.arange(n)]
    while todo:
        some = todo.pop()
        if len(some) <= BLOCK:
            out.append(some)
            continue
        part = x[some] - x[some].mean(0)
        axis = np.linalg.eigh(part.T @ part)[1][:, -1]
        half = -(-len(some) // (2 * BLOCK)) * BLOCK
        some = some[np.argsort(part @ axis, kind="stable")]
        todo += [some[half:], some[:half]]
    return np.concatenate(out)


def _direction(k: np.ndarray, c: np.ndarray) -> tuple[bytes, bytes]:
    """Equal for counts that give one unit vector."""
    return k.tobytes(), b"" if (c == c[:1]).all() else c.tobytes()


def index_of(rows: list[tuple[int | None, np.ndarray, np.ndarray, int]], words: list[str], doc_freq: np.ndarray, n_docs: int, of: dict[int, float]) -> Index:
    """The index of (id, words, counts, toxic) rows over sorted ``words``, not yet calibrated."""
    total = [sum(y == c for _, _, _, y in rows) for c in (0, 1)]
    seen = [np.bincount(np.concatenate([k for _, k, _, y in rows if y == c] or [np.zeros(0, np.int64)]), minlength=len(words)) for c in (0, 1)]
    weight = (np.log((1 + n_docs) / (1 + doc_freq)) + 1) * telling(seen[1], seen[0], total[1], total[0])
    of_all = sum(of[y] for _, _, _, y in rows)
    base = (sum(of[1] for _, _, _, y in rows if y) + 0.5) / (of_all + 1)
    same: dict[tuple[bytes, bytes], list] = {}
    for i, k, c, y in rows:
        held = same.setdefault(_direction(k, c), [k, c, 0, 0.0, 0.0, i])
        held[2], held[3], held[4], held[5] = held[2] + 1, held[3] + of[y], held[4] + of[y] * y, min(held[5], i)
    none = same.pop((b"", b""), [None, None, 0, 0.0, 0.0, 0])
    blank = (none[4] + base) / (none[3] + 1)
    held = sorted(same.values(), key=lambda h: (h[5], h[0].tobytes(), h[1].tobytes()))
    lone = Index({w: k for k, w in enumerate(words)}, weight, *[np.zeros(0)] * 13, blank)
    if not held:
        return replace(lone, entries=np.zeros(len(words) + 1, np.int64), postings=np.zeros(1, np.int64), block=np.zeros(0, np.int64), example=np.zeros(0, np.int64))
    sizes = np.array([len(h[0]) for h in held])
    starts, word = np.r_[0, np.cumsum(sizes)], np.concatenate([h[0] for h in held])
    value = np.concatenate([lone.unit(h[0], h[1]) for h in held])
    rank = dealt(starts, word, value, len(words))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    example = np.repeat(place, sizes)
    order = np.lexsort((example, word))
    word, example, value = word[order], example[order], value[order]
    begins = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (example[1:] // BLOCK != example[:-1] // BLOCK)])
    entries = np.searchsorted(word[begins], np.arange(len(words) + 1))
    block, peak, postings = example[begins] // BLOCK, np.maximum.reduceat(value, begins), np.r_[begins, len(word)]
    blocks = -(-len(held) // BLOCK)
    wide = np.flatnonzero(np.diff(entries) > WIDE * blocks)
    row = np.full(len(words), -1)
    row[wide] = np.arange(len(wide))
    wide_peak, wide_value = np.zeros((len(wide), blocks)), np.zeros((len(wide), blocks * BLOCK))
    for r, w in enumerate(wide):
        own = slice(entries[w], entries[w + 1])
        wide_peak[r, block[own]] = peak[own]
        own = slice(postings[entries[w]], postings[entries[w + 1]])
        wide_value[r, example[own]] = value[own]
    n, mass, toxic, ids = (np.array([held[e][j] for e in rank]) for j in (2, 3, 4, 5))
    return replace(lone, entries=entries, block=block, peak=peak, postings=postings, example=example, value=value, row=row, wide_peak=wide_peak, wide_value=wide_value.reshape(-1, BLOCK), n=n, mass=mass, toxic=toxic, ids=ids)


def vectors_of(index: Index) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, unit vector) of each example."""
    word = np.repeat(np.arange(len(index.entries) - 1), np.diff(index.postings[index.entries]))
    order = np.lexsort((word, index.example))
    cuts = np.searchsorted(index.example[order], np.arange(1, len(index.n)))
    return list(zip(np.split(word[order], cuts), np.split(index.value[order], cuts)))


def calibrated(index: Index, shares: list[tuple[float, float]], of: dict[int, float]) -> Index:
    """The index with the logistic fit of labels on the votes (toxic's, clean's) that each example gets without itself."""
    rows = [(s, y, m) for (a, b), t, m0 in zip(shares, index.toxic, index.mass - index.toxic) for s, y, m in ((a, 1, t), (b, 0, m0)) if m > 0]
    x, y, m = (np.array(c, float) for c in zip(*rows)) if rows else (np.zeros(0),) * 3
    offset, scale = logistic(x, y, m)
    return replace(index, offset=offset, scale=scale)


def build(rows: list[tuple[int | None, Counter, int]], words: list[str], doc_freq: dict[str, int]) -> Index:
    """The index of (id, counts, toxic) rows, calibrated in this process."""
    words = sorted(words)
    at, of = {w: k for k, w in enumerate(words)}, {0: 1.0, 1: 1.0}
    coded = []
    for i, counts, y in rows:
        pairs = sorted((at[w], c) for w, c in counts.items() if w in at)
        coded.append((i, np.array([k for k, _ in pairs], np.int64), np.array([c for _, c in pairs], np.int64), y))
    index = index_of(coded, words, np.array([doc_freq[w] for w in words], float), len(rows), of)
    return calibrated(index, [index.without_itself(e, k, v, of) for e, (k, v) in enumerate(vectors_of(index))] if len(index.n) else [], of)


def logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Offset and non-negative slope of y on x, rows weighing ``mass``, by Newton steps with a small ridge."""
    if not len(x):
        return 0.0, 0.0
    a, b = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(b @ a, -30, 30)))
        grad = b.T @ (mass * (y - p)) - 1e-2 * a
        step = np.linalg.solve((b * (mass * p * (1 - p))[:, None]).T @ b + 1e-2 * np.eye(2), grad)
        a = a + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), max(0.0, float(a[1]))


# ---------------------------------------------------------------- over DataFrames


def code_texts(texts: list[str | None], words: dict[str, int], memo: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """(known words, counts) of each text; equal texts are read once."""
    out = []
    for t in texts:
        key = xxhash.xxh3_128_digest(t) if t else b""
        if key not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            found = sorted((words[w], c) for w, c in word_counts(t).items() if w in words)
            flat = np.array(found, np.int32).reshape(-1, 2)
            memo[key] = np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])
        out.append(memo[key])
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def coded(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(id, k, c) of each row: the words of ``vocabulary`` (a broadcast dictionary) in its whole text and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, memo = vocabulary.value, {}
        for batch in batches:
            found = code_texts(batch.column(1).to_pylist(), words, memo)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([k for k, _ in found]), _lists([c for _, c in found])], names=["id", "k", "c"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, k array<int>, c array<int>")


def labelled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> tuple[list, list[str], dict[int, float]]:
    """(rows, words, class weights): the sample's (id, words, counts, toxic), its sorted words, and the labelled ids that one sampled id of a class stands for."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").where(crc_of_id(F.col("id")) % 5 != 0)
    known = known.groupBy("id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    per_class = {y: n for y, n in known.groupBy("toxic").count().collect()}
    chosen = known.where(in_sample(F.col("id"), F.col("toxic"), per_class, sample))

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            found = [sorted(word_counts(t if isinstance(t, str) else None).items()) for t in some]
            yield pd.DataFrame({"words": [" ".join(w for w, _ in f) for f in found], "counts": [[c for _, c in f] for f in found]})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.select("id", "toxic", F.xxhash64("text").alias("same"), F.pandas_udf(count, "words string, counts array<int>")("text").alias("w")).select("id", "toxic", "same", "w.*").toArrow()
    held: dict[tuple[int, int], tuple] = {}
    seen: dict[str, int] = {}
    for batch in rows.to_batches(max_chunksize=100):  # few texts' words at a time are Python objects
        for r in batch.to_pylist():
            key = (r["toxic"], r["same"])
            if key not in held or r["id"] < held[key][0]:
                held[key] = (r["id"], np.array([seen.setdefault(w, len(seen)) for w in r["words"].split()], np.int64), np.array(r["counts"], np.int64))
    del rows
    words = sorted(seen)
    rank = np.empty(len(words), np.int64)
    rank[[seen[w] for w in words]] = np.arange(len(words))
    found = []
    for (y, _), (i, own, c) in held.items():
        order = np.argsort(rank[own])
        found.append((i, rank[own][order], c[order], y))
    sizes = Counter(y for *_, y in found)
    return sorted(found, key=lambda r: (r[0], r[3], r[1].tobytes(), r[2].tobytes())), words, {y: per_class.get(y, 0) / max(1, sizes[y]) for y in (0, 1)}


def _index(spark: SparkSession, rows: list, words: list[str], of: dict[int, float], texts: DataFrame) -> Index:
    """The calibrated index; document frequencies are counted over all of ``texts`` (k)."""
    freq, n = np.zeros(len(words)), texts.count()
    found = texts.select(F.explode("k").alias("k")).groupBy("k").count().toArrow()
    freq[found.column("k").to_numpy()] = found.column("count").to_numpy()
    index = index_of(rows, words, freq, n, of)
    if not len(index.n):
        return calibrated(index, [], of)
    held = spark.sparkContext.broadcast((index, vectors_of(index)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vectors = held.value
        for batch in batches:
            at = batch.column(0).to_pylist()
            found = [index.without_itself(e, *vectors[e], of) for e in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in zip(*found))] if found else [batch.column(0), pa.array([], pa.float64()), pa.array([], pa.float64())], names=["id", "a", "b"])

    parts = max(1, min(spark.sparkContext.defaultParallelism, len(index.n) // 64))
    shares = spark.range(0, len(index.n), 1, parts).mapInArrow(run, "id long, a double, b double").toArrow().to_pydict()
    held.unpersist()
    votes = dict(zip(shares["id"], zip(shares["a"], shares["b"])))
    return calibrated(index, [votes[e] for e in range(len(index.n))], of)


def _scores(index: Index, parts: list[tuple[np.ndarray, np.ndarray]], memo: dict) -> tuple[list[float], list[list[int]]]:
    out = []
    for k, c in parts:
        key = xxhash.xxh3_128_digest(k.tobytes() + c.tobytes())
        if key not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            memo[key] = index.score(k, c)
        out.append(memo[key])
    return [s for s, _ in out], [e for _, e in out]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index over about ``sample`` labelled documents of each class (all, if it has fewer).

    Labels whose crc32(id) mod 5 is 0, null ids and null labels are not read. An id that is labelled
    more than once is toxic if any of its labels is. Ids are picked by their hash, so nothing is
    ranked in one task; a sampled example votes for as many labelled ones as it stands for, so scores
    don't drift with the size of the table. Equal texts of a class are one example, with its smallest id.
    All words of the sample are in the vectors, with document frequencies over all of ``docs``. An empty
    table of labels gives an index that scores everything alike. Extra columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, words, of = labelled(docs, labels, sample, id_col, text_col)
    vocabulary = spark.sparkContext.broadcast({w: k for k, w in enumerate(words)})
    texts = cut(coded(docs, vocabulary, id_col, text_col).select("k"), "coded")
    index = _index(spark, rows, words, of, texts)
    remove(spark, texts)
    return index


def score(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``toxicity``: score (0 to 1) and evidence (ids of the nearest examples).

    Null and empty texts, and those without any word of the examples, get the calibrated share of the
    examples like them. Whole texts are read; equal texts get equal scores, and neighbours that tie all
    vote. No shuffle. A column ``toxicity`` that ``docs`` has already is replaced.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index, seen, memo = held.value, {}, {}
        for some in texts:
            parts = code_texts([t if isinstance(t, str) else None for t in some], index.words, seen)
            scores, near = _scores(index, parts, memo)
            yield pd.DataFrame({"score": scores, "evidence": near})

    return docs.withColumn("toxicity", F.pandas_udf(run, "score double, evidence array<long>")(F.col(text_col)))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence) for each row of ``docs``: ``fit`` and ``score`` of the same table, whose texts are read into word numbers once."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, words, of = labelled(docs, labels, sample, id_col, text_col)
    vocabulary = spark.sparkContext.broadcast({w: k for k, w in enumerate(words)})
    texts = cut(coded(docs, vocabulary, id_col, text_col), "coded")
    held = spark.sparkContext.broadcast(replace(_index(spark, rows, words, of, texts), words={}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = held.value, {}
        for batch in batches:
            k, c = batch.column(1), batch.column(2)
            ends, k, c = k.offsets.to_numpy()[1:-1] - k.offsets[0].as_py(), k.flatten().to_numpy(), c.flatten().to_numpy()
            scores, near = _scores(index, list(zip(np.split(k, ends), np.split(c, ends))), memo) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64()))], names=["id", "score", "evidence"])

    return texts.mapInArrow(run, "id long, score double, evidence array<long>").withColumnRenamed("id", id_col)
