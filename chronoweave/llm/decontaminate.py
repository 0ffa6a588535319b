"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks.

1. One pass over the texts keeps the places of the words that the benchmark uses, without those in a large share of
   its items; document frequencies are counted over all documents, and terms in more than `max_df` of them are
   dropped, but for the rarest of each item.
2. Passages are windows of `LENGTH` words, one every `STRIDE`; items are cut into chunks that a window can hold, so
   that a short item is not lost in a long passage and a long one still fills several. The TF-IDF rows A are never
   stored: a distributed randomised SVD multiplies A'(A Omega) and then (AQ)'(AQ) by partition and adds up the
   partial products, whose size depends on the block alone. Rank: the number of chunks plus an oversample, so that no
   chunk is without a direction of its own.
3. Passages with two or more features (one, if some chunk has no more) whose latent vector has at least the cosine
   `min_cosine` with an item's chunk are candidates. Words that occur in no document are left out of the chunks.
4. Candidates are read again from the text: the share of the item's words in the longest common subsequence with the
   passage must reach `min_lcs`; or `paraphrase_lcs`, if the item's answer (its last sentence) is there in order.

The benchmark is a parameter; it streams through the driver in blocks of `BLOCK_CHUNKS` chunks, each of which reads the
corpus once. An item with more chunks than a block has goes through several.

Cases: items or texts that are null or without words match nothing. Repeated items are matched each. Rows with equal
keys are one document; so are rows without a key, which are found with a null key. An empty table on either side gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import checkpointed, small

BLOCK_CHUNKS, OVERSAMPLE, LENGTH, STRIDE, CHUNK = 512, 16, 64, 32, 48
#: A document in the plan: two hashes of its text.
DOC = "struct<a: bigint, b: bigint>"
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit vectors: one step for each word of b."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer_of(text: str) -> list[str]:
    """The words of the last sentence that has some."""
    parts = [tokens(p) for p in _SENTENCE.split(text)]
    return next((p for p in reversed(parts) if p), [])


def in_order(needle: list[str], hay: list[str]) -> bool:
    it = iter(hay)
    return all(w in it for w in needle)


def around(start: int, size: int, n: int) -> tuple[int, int]:
    """The part of a text of n words that may hold an item of `size` words found about `start`."""
    return max(0, start - LENGTH // 2), min(n, max(0, start + size + LENGTH + LENGTH // 2))


def stretches(low: int, high: int, size: int) -> set[tuple[int, int]]:
    """Overlapping parts half as long again as the item: a subsequence scattered over more would be made of common words."""
    wide, step = size + size // 2, max(1, size // 4)
    return {(p, min(high, p + wide)) for p in range(low // step * step, max(low + 1, high - size + step), step)}


class Terms:
    """The benchmark's words: which are features, before the corpus is known."""

    def __init__(self, items: list[list[str]], stop_share: float = 0.05, least: int = 6):
        df = Counter(w for t in items for w in set(t))
        often = max(3, stop_share * len(items))
        keep = {w for w, n in df.items() if n <= often}
        for t in items:
            keep.update(sorted(set(t), key=lambda w: (df[w], w))[:least])
        self.words = sorted(keep)
        self.index = {w: i for i, w in enumerate(self.words)}


def _places(terms: Terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = terms.index.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keep, place, term = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = tokens(text)
                    ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                    p = np.nonzero(ids >= 0)[0]
                    if len(p):
                        keep.append(i)
                        place.append(p.astype(np.int32))
                        term.append(ids[p])
                if keep:
                    n = np.r_[0, np.cumsum([len(p) for p in place])].astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(n), pa.array(np.concatenate(x))) for x in (place, term)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), *lists], names=["doc", "place", "term"])

    return run


class Space:
    """Everything a task needs: weights of terms, passage length, latent basis, chunks of items in it."""

    def __init__(self, idf: np.ndarray, length: int):
        self.idf, self.length = idf.astype(np.float32), length
        self.basis: np.ndarray | None = None
        self.chunks: np.ndarray | None = None
        self.owner: list[tuple[int, int]] = []  # item of each chunk, and where in it the chunk begins

    def rows(self, batch: pa.RecordBatch):
        """Passages of a batch: (row of the document, start, offsets, terms, weights), only those with a weight."""
        lists = batch.column(1)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        place, term = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        ok = self.idf[term] > 0
        place, term, doc = place[ok].astype(np.int64), term[ok].astype(np.int64), doc[ok].astype(np.int64)
        # a word at place p lies in the windows that start at the multiples of STRIDE in (p - length, p]
        last = place // STRIDE
        first = np.maximum(0, (place - self.length) // STRIDE + 1)
        n = last - first + 1
        at = np.repeat(np.arange(len(place)), n)
        window = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        # under 2^9 rows, 2^32 windows and BLOCK_CHUNKS * LENGTH terms
        key = (doc[at] << 32 | window) * len(self.idf) + term[at]
        key, count = np.unique(key, return_counts=True)
        col, passage = key % len(self.idf), key // len(self.idf)
        weight = (self.idf[col] * (1 + np.log(count))).astype(np.float32)
        cut = np.nonzero(np.r_[True, passage[1:] != passage[:-1]])[0] if len(passage) else np.empty(0, np.int64)
        norm = np.sqrt(np.add.reduceat(weight * weight, cut)) if len(cut) else np.empty(0, np.float32)
        size = np.diff(np.r_[cut, len(passage)])
        weight = weight / np.repeat(norm, size)
        starts = passage[cut]
        return starts >> 32, (starts & 0xFFFFFFFF) * STRIDE, cut, size, col, weight

    def project(self, basis: np.ndarray, cut: np.ndarray, col: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.add.reduceat(basis[col] * weight[:, None], cut, axis=0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield batch.slice(at, 500)


def _blocks(m: np.ndarray) -> pa.RecordBatch:
    rows = np.flatnonzero(m.any(1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(m[rows].astype(np.float64)), pa.list_(pa.float64()))], names=["r", "v"])


def _total(df: DataFrame, fn, shape: tuple[int, int], pieces: int) -> np.ndarray:
    """Adds the matrices that `fn` makes of each partition; the sum of one row is one group, with partial sums."""
    parts = df.mapInArrow(fn, "r int, v array<double>")
    sums = parts.groupBy("r").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(shape[1])]).alias("v")) if shape[1] <= 32 else None
    if sums is None:
        # many columns: one row for each (row, 32 columns), still with partial sums on the map side
        cut = parts.select("r", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(-(-shape[1] // 32) - 1)), lambda i: F.slice("v", i * 32 + 1, F.lit(32)))).alias("c", "v"))
        sums = cut.groupBy("r", "c").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(32)]).alias("v"))
    out = np.zeros((shape[0], -(-shape[1] // 32) * 32))
    for row in sums.toLocalIterator():
        c = row["c"] * 32 if "c" in row.__fields__ else 0
        v = [x or 0.0 for x in row["v"]]
        out[row["r"], c : c + len(v)] = v
    return out[:, : shape[1]]


def randomised_svd(passages: DataFrame, space: Space, rank: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of the passages' TF-IDF rows."""
    sc, n = passages.sparkSession.sparkContext, len(space.idf)
    rank = min(rank, n)
    shared = sc.broadcast((space, np.random.default_rng(seed).normal(size=(n, rank)).astype(np.float32)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, omega = shared.value
        out, seen = np.zeros((n, rank)), False
        for batch in _slices(batches):
            _, _, cut, size, col, weight = own.rows(batch)
            if len(cut):
                y, seen = own.project(omega, cut, col, weight), True
                part = np.repeat(y, size, axis=0) * weight[:, None]
                order = np.argsort(col, kind="stable")
                first = np.nonzero(np.diff(col[order], prepend=-1))[0]
                out[col[order][first]] += np.add.reduceat(part[order], first, axis=0)
        if seen:
            yield from pa.Table.from_batches([_blocks(out)]).to_batches(max_chunksize=1000)

    z = _total(passages, sketch, (n, rank), 0)
    q = np.linalg.qr(z)[0].astype(np.float32)
    basis = sc.broadcast((space, q))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, b = basis.value
        out = np.zeros((b.shape[1], b.shape[1]))
        for batch in _slices(batches):
            _, _, cut, _, col, weight = own.rows(batch)
            if len(cut):
                y = own.project(b, cut, col, weight)
                out += y.T @ y
        yield _blocks(out)

    g = _total(passages, gram, (q.shape[1], q.shape[1]), 0)
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)
    keep = order[values[order] > 1e-9 * max(values.max(), 1e-30)]
    shared.unpersist()
    return (q @ vectors[:, keep]).astype(np.float32), np.sqrt(values[keep])


def _candidates(shared, min_cosine: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in _slices(batches):
            doc, start, cut, size, col, weight = space.rows(batch)
            several = size >= least  # a passage that shares one word with the benchmark holds no item
            own = np.repeat(several, size)
            doc, start, col, weight = doc[several], start[several], col[own], weight[own]
            cut = np.cumsum(np.r_[0, size[several]])[:-1]
            found: dict[tuple[int, int], dict[int, float]] = {}
            for at in range(0, len(cut), 4000):
                stop = cut[at + 4000] if at + 4000 < len(cut) else len(col)
                low = cut[at]
                z = space.project(space.basis, cut[at : at + 4000] - low, col[low:stop], weight[low:stop])
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                near = z @ space.chunks.T
                for i, j in zip(*np.nonzero(near >= min_cosine), strict=True):
                    item, offset = space.owner[j]
                    hits = found.setdefault((int(doc[at + i]), item), {})
                    place = int(start[at + i]) - offset
                    hits[place] = max(hits.get(place, 0.0), float(near[i, j]))
            if found:
                keys = list(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d for d, _ in keys])), pa.array([j for _, j in keys], pa.int32()), pa.array([sorted(found[k]) for k in keys], pa.list_(pa.int32())), pa.array([max(found[k].values()) for k in keys], pa.float64())], names=["doc", "item", "starts", "cosine"])

    return run


def _check(shared, min_lcs: float, paraphrase_lcs: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, answers, ids = shared.value
        counts = [Counter(t) for t in items]
        for batch in batches:
            out = []
            for i, (text, hits) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = tokens(text)
                for hit in hits:
                    item, answer = items[hit["item"]], answers[hit["item"]]
                    best = (0.0, False)
                    need, has = min(min_lcs, paraphrase_lcs) * len(item), counts[hit["item"]]
                    near = set()
                    for start in hit["starts"]:
                        # a common subsequence has no word more often than the item
                        low, high = around(start, len(item), len(words))
                        if sum(map(has.__getitem__, has.keys() & set(words[low:high]))) >= need:
                            near |= stretches(low, high, len(item))
                    low, high = min((a for a, _ in near), default=0), max((b for _, b in near), default=0)
                    known = list(accumulate((w in has for w in words[low:high]), initial=0))
                    for a, b in sorted(near):
                        if known[b - low] - known[a - low] < need:
                            continue
                        best = max(best, (lcs_length(item, words[a:b]) / len(item), in_order(answer, words[a:b])))
                    if best[0] >= min_lcs or (best[0] >= paraphrase_lcs and best[1]):
                        out.append((i, ids[hit["item"]], hit["cosine"], *best))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c[0])), pa.array(c[1]), pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.bool_())], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", max_df: float = 0.01, min_cosine: float = 0.2, min_lcs: float = 0.7, paraphrase_lcs: float = 0.55) -> DataFrame:
    """Rows (doc_id, item_id, cosine, lcs, answer): the items that each document holds."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    out = spark.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, cosine double, lcs double, answer boolean")
    own = benchmark.select(F.col(item_key).alias("id"), F.col(item_text).alias("t")).where("t is not null")
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")).alias("doc"))
    total = None
    for rows, chunks in _benchmark_blocks(r for r in own.orderBy("id", "t").toLocalIterator()):
        total = source.count() if total is None else total
        out = out.unionByName(_block(source, kind, item_kind, rows, chunks, total, max_df, min_cosine, min_lcs, paraphrase_lcs))
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def chunks_of(words: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the chunks of an item; a short rest belongs to the last one."""
    starts = range(0, max(1, len(words) - CHUNK // 3), CHUNK)
    return [(at, len(words) if at == starts[-1] else at + CHUNK) for at in starts]


def _benchmark_blocks(rows: Iterator) -> Iterator[tuple[list, list]]:
    """Items (id, words, answer) and the chunks (item, start, end) to look for, BLOCK_CHUNKS at a time."""
    items: list[tuple] = []
    chunks: list[tuple[int, int, int]] = []
    for r in rows:
        words = tokens(r["t"])
        for at, end in chunks_of(words) if words else []:
            if len(chunks) == BLOCK_CHUNKS:
                yield items, chunks
                items, chunks = [], []
            if not chunks or at == 0:
                items.append((r["id"], words, answer_of(r["t"])))
            chunks.append((len(items) - 1, at, end))
    if chunks:
        yield items, chunks


def _block(source: DataFrame, kind: str, item_kind: str, rows: list, chunks: list[tuple[int, int, int]], total: int, max_df: float, min_cosine: float, min_lcs: float, paraphrase_lcs: float) -> DataFrame:
    spark = source.sparkSession
    sc = spark.sparkContext
    items = [r[1] for r in rows]
    parts = [items[i][at:end] for i, at, end in chunks]
    terms = Terms(parts)
    places = checkpointed(source.where("text is not null").select("doc", "text").mapInArrow(_places(terms), f"doc {DOC}, place array<int>, term array<int>"))
    df = np.zeros(len(terms.words))
    for r in places.select(F.explode(F.array_distinct("term")).alias("t")).groupBy("t").count().collect():  # at most the words of the chunks
        df[r["t"]] = r["count"]
    idf = np.log((1 + total) / (1 + df))
    often = df > max_df * total
    for t in parts:  # the rarest terms of a chunk stay
        often[sorted({j for w in t if (j := terms.index.get(w)) is not None and df[j]}, key=lambda i: (df[i], i))[:6]] = False
    idf[~often] = np.maximum(idf[~often], 0.1)
    idf[often | (df == 0)] = 0
    space = Space(idf, LENGTH)
    basis, _ = randomised_svd(places, space, len(chunks) + OVERSAMPLE)
    vectors = np.zeros((len(chunks), len(terms.words)), np.float32)
    for k, t in enumerate(parts):
        for w, n in Counter(x for x in t if x in terms.index).items():
            vectors[k, terms.index[w]] = idf[terms.index[w]] * (1 + math.log(n))
    latent = vectors @ basis
    space.basis, space.owner = basis, [(i, at) for i, at, _ in chunks]
    space.chunks = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    least = min([2, *filter(None, (np.count_nonzero(v) for v in vectors))])
    near = places.mapInArrow(_candidates(sc.broadcast(space), min_cosine, least), f"doc {DOC}, item int, starts array<int>, cosine double")
    near = near.groupBy("doc", "item").agg(F.first("starts").alias("starts"), F.max("cosine").alias("cosine"))  # equal texts have equal hits
    hits = checkpointed(near.groupBy("doc").agg(F.collect_list(F.struct("item", "starts", "cosine")).alias("hits")))
    starts = F.aggregate("hits", F.lit(0), lambda n, h: n + 2 + F.size(h["starts"]))
    texts = source.join(small(hits, 20_000, starts), "doc").select("doc_id", "text", "hits")
    checked = sc.broadcast((items, [r[2] for r in rows], [r[0] for r in rows]))
    return texts.mapInArrow(_check(checked, min_lcs, paraphrase_lcs), f"doc_id {kind}, item_id {item_kind}, cosine double, lcs double, answer boolean")
