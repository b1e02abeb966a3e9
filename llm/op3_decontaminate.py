"""Benchmark decontamination by latent semantic retrieval.

1. The words of every whole text that also occur in the benchmark become numbers
   (others 0) and are written once to the shared folder; their counts over all
   documents give the inverse frequencies.  Words so common that they tell
   nothing are left out of the vectors, but each item keeps its rarest words.
2. Passages are overlapping windows.  A randomised SVD of their TF-IDF matrix
   over all documents: each task multiplies its passages with a random matrix
   and back, the products are summed in Spark by blocks of rows, and the driver
   orthogonalises a matrix of (benchmark words) x (rank).
3. Items are the queries.  Passages whose cosine to an item in the latent space
   reaches the bound are its candidates; a task compares its passages with all
   items of a block, so that no pair leaves a task unverified.  Repeated words
   count with the logarithm of their number, and items much shorter or longer
   than a passage are compared with passages near their own length too.
4. A candidate counts if the longest common subsequence with the item, over the
   passage and its surroundings, holds enough of the item's words, and if the
   answer check passes: most of the item's rarest words occur there too, or, where
   a paraphrase replaced them, a larger share of all words and half of its telling ones.
   An inverted index of the items' telling words counts first which stretches of a
   text hold enough of one item's to pass; only passages of those are projected.
5. All words of an item in a row are a copy, however short it is, whatever the
   cosine: they are looked up by the item's rarest word.

Bound: the benchmark's texts go to every task, at most BLOCK items at once;
larger benchmarks are worked off in blocks.  The sums of the SVD are added up in a
tree of FAN partial sums at a time, so no task holds those of all.  Nothing else is
collected that grows with the documents.

Defined results: null and blank texts match nothing; items without words match
nothing; equal items each match, and of equally good passages the first counts.
Empty tables of documents or items give no rows.  A long text is looked at whole,
by one task, in runs of about a million words.  Repeated rows match each; a null
doc_id is carried along.  Only doc_id, text and item_id, text are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, ship, text_hash, written
from .textscan import LOWER, NON_ALNUM, mix, pieces, span_hashes, text_bytes, words

BLOCK, RANK, STEP, SPAN = 5000, 128, 16, 3
COSINE, COMMON, ANSWER = 0.35, 0.0003, 5
SUBSEQUENCE = 0.6
#: What a paraphrase without the answer words must reach: cosine, share of all words, share of the telling ones; and its item's words.
REPLACED, SHORTEST = (0.45, 0.7, 0.5), 8
FAN = 64
_NUMBER_BASE = 0xA0761D6478BD642F | 1


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64; kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = max(1024, 1 << int(n + 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            take = min(done, size - done)
            have[done : done + take] = have[:take] * step
            done += take
        _POWERS[base] = have
    return have[: n + 1]


def _codes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and each row's first word, for runs of rows."""
    raw, at = text_bytes(texts)
    for a, b in pieces(np.diff(at)):
        part = LOWER[raw[at[a] : at[b]]]
        start, end, first = words(part, at[a : b + 1] - at[a], NON_ALNUM)
        yield span_hashes(part, start, end), first


class Items:
    """A block of benchmark items as word numbers; 0 is any word that no item has."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        codes, first = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        runs = [*_codes(pa.array(texts, pa.string()))]
        if runs:
            codes = np.concatenate([c for c, _ in runs])
            before = np.cumsum([0, *(len(c) for c, _ in runs)])
            # Each run counts its words from 0 and ends with their number, where the next begins.
            first = np.concatenate([[0], *(f[1:] + n for (_, f), n in zip(runs, before[:-1], strict=True))])
        self.ids = ids
        self.known = np.unique(codes)
        numbers = np.searchsorted(self.known, codes) + 1
        self.words = [numbers[first[k] : first[k + 1]] for k in range(len(ids))]

    def number(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(codes), np.uint32)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at + 1, 0).astype(np.uint32)


def numbered(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, text_hash, n_words and the words' numbers (16 bits where they suffice)."""
    kind = "<u2" if len(items.known) < (1 << 16) - 1 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("numbers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for codes, first in _codes(batch.column(1)):
                data, n = items.number(codes).astype(kind), len(first) - 1
                size = data.itemsize
                # Documents without a word of the benchmark need no bytes.
                some = np.add.reduceat(np.append(data > 0, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0) if n else []
                flat = data.tobytes()
                blocks = [flat[first[k] * size : first[k + 1] * size] if some[k] else b"" for k in range(n)]
                yield pa.record_batch([batch.column(0).slice(done, n), batch.column(2).slice(done, n), pa.array(np.diff(first)), pa.array(blocks, pa.binary())], schema=schema)
                done += n

    return docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("h")).mapInArrow(run, "doc_id long, text_hash long, n_words long, numbers binary")


def _rows(batch: pa.RecordBatch, kind: str, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Numbers of runs of documents, where each begins, and the first document's row."""
    blocks = batch.column("numbers").to_pylist()
    sizes = np.array([len(b or b"") for b in blocks]) // np.dtype(kind).itemsize
    for a, b in pieces(sizes, most):
        data = np.frombuffer(b"".join(x or b"" for x in blocks[a:b]), kind).astype(np.int64)
        yield data, np.concatenate([[0], np.cumsum(sizes[a:b])]), a


class Telling:
    """Finds stretches that hold enough of an item's telling words, counted with their repetitions: no passage that could
    pass the checks is lost."""

    def __init__(self, words: list[np.ndarray], some: np.ndarray, answers: list[set], weight: np.ndarray, size: int):
        pairs = [(w, k, w in answers[q]) for k, q in enumerate(some.tolist()) for w in np.unique(words[q]).tolist() if weight[w] > 0]
        word, item, rare = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        order = np.argsort(word, kind="stable")
        self.item, self.rare = item[order], rare[order] > 0
        self.count = np.bincount(word, minlength=len(weight))
        self.begin = np.cumsum(self.count) - self.count
        self.reach = max((len(words[q]) for q in some.tolist()), default=0)
        self.width, self.size, self.length = size + 2 * self.reach, size, np.array([len(words[q]) for q in some.tolist()], np.int64)
        telling = np.array([np.count_nonzero(weight[words[q]] > 0) for q in some.tolist()], np.int64)
        self.needed = np.where([len(words[q]) >= SHORTEST for q in some.tolist()], np.ceil(REPLACED[2] * telling), 1 << 40)
        self.answers = np.array([len(answers[q]) // 2 + 1 for q in some.tolist()], np.int64)

    def pairs(self, data: np.ndarray, first: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows, numbered over all documents, and items that may pass there: first by stretches two widths long, of
        which one holds all of a window's surroundings, then by the surroundings themselves."""
        n, width = max(1, len(self.needed)), self.width
        parts = np.diff(first) // width + 1
        base = np.concatenate([[0], np.cumsum(parts)])
        at = np.flatnonzero(self.count[data])
        doc = np.searchsorted(first, at, side="right") - 1
        cell = (at - first[doc]) // width
        found, hits_of, rares_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = max(1, 4_000_000 // n)
        # Stretch c goes from c to c + 2 widths; so many stretches at once that their counts stay small.
        for low in range(0, int(base[-1]), size):
            here = np.flatnonzero((base[doc] + cell >= low) & (base[doc] + cell <= low + size))
            count = self.count[data[at[here]]]
            entry = np.repeat(self.begin[data[at[here]]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            own, local = np.repeat(base[doc[here]] + cell[here], count), np.repeat(cell[here], count)
            item, rare = self.item[entry], self.rare[entry]
            place = item * (len(data) + 1) + np.repeat(at[here], count)
            hits_of.append(place[own < low + size])
            rares_of.append(place[rare & (own < low + size)])
            for back in (0, 1):
                ok = (own - back >= low) & (own - back < low + size) & (local >= back)
                key = (own[ok] - back - low) * n + item[ok]
                hits = np.bincount(key, minlength=size * n) if not back else hits + np.bincount(key, minlength=size * n)
                rares = np.bincount(key[rare[ok]], minlength=size * n) if not back else rares + np.bincount(key[rare[ok]], minlength=size * n)
            enough = (hits.reshape(size, n) >= self.needed) | (rares.reshape(size, n) >= self.answers)
            found.append(np.flatnonzero(enough) + low * n)
        blocks = -(-np.diff(first) // step)
        start = np.concatenate([[0], np.cumsum(blocks)])
        doc = np.repeat(np.arange(len(blocks)), blocks)
        a = (np.arange(start[-1]) - start[doc]) * step
        keys, hits, rares = (np.sort(np.concatenate(x)) for x in (found, hits_of, rares_of))
        begin, passing = np.searchsorted(keys, np.arange(int(base[-1]) + 1) * n), keys % n
        stretch = base[doc] + np.maximum(a - self.reach, 0) // width
        count = np.diff(begin)[stretch]
        some = np.flatnonzero(count)
        for low, high in pieces(count[some], 1 << 18):
            w, c = some[low:high], count[some[low:high]]
            k = passing[np.repeat(begin[stretch[w]] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            w = np.repeat(w, c)
            from_, to = (np.clip(x, first[doc[w]], first[doc[w] + 1]) + k * (len(data) + 1) for x in (first[doc[w]] + a[w] - self.length[k], first[doc[w]] + a[w] + self.size + self.length[k]))
            ok = (np.searchsorted(hits, to) - np.searchsorted(hits, from_) >= self.needed[k]) | (np.searchsorted(rares, to) - np.searchsorted(rares, from_) >= self.answers[k])
            yield w[ok], k[ok]


def _cells(data: np.ndarray, first: np.ndarray, weight: np.ndarray, step: int, span: int, wanted: np.ndarray | None = None):
    """The sparse TF-IDF matrix of all windows of `span` blocks of `step` words: rows, columns, values;
    each window's document and first word, and its number among all windows.  Windows without a weighted word, or not wanted, are left out."""
    size = np.diff(first)
    where = np.flatnonzero(weight[data] > 0)
    doc = np.searchsorted(first, where, side="right") - 1
    block = (where - first[doc]) // step
    blocks = -(-size // step)
    base = np.concatenate([[0], np.cumsum(blocks)])
    # A window is named by its first block, and may begin before the document's first.
    rows, columns = [], []
    for back in range(span):
        ok = block - back >= 0
        rows.append((base[doc] + block - back)[ok])
        columns.append(data[where][ok])
    row, column = np.concatenate(rows), np.concatenate(columns)
    if wanted is not None:
        ok = wanted[row]
        row, column = row[ok], column[ok]
    key, count = np.unique(row * len(weight) + column, return_counts=True)
    row, column = key // len(weight), key % len(weight)
    names, row = np.unique(row, return_inverse=True)
    owner = np.searchsorted(base, names, side="right") - 1
    return row, column, _damped(count) * weight[column], len(names), owner, (names - base[owner]) * step, names


def _damped(count: np.ndarray) -> np.ndarray:
    """So that one word said over and over does not outweigh a passage."""
    return 1 + np.log(count)


def _times(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """Sparse times dense; rows come sorted and each has an entry."""
    out = np.empty((n, matrix.shape[1]), np.float32)
    begin = np.searchsorted(row, np.arange(n + 1))
    for a in range(0, n, 4096):
        b = min(a + 4096, n)
        lo, hi = begin[a], begin[b]
        out[a:b] = np.add.reduceat(matrix[column[lo:hi]] * value[lo:hi, None].astype(np.float32), begin[a:b] - lo, axis=0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _item_cells(items: Items, weight: np.ndarray):
    data = np.concatenate(items.words) if items.words else np.zeros(0, np.int64)
    item = np.repeat(np.arange(len(items.words)), [len(w) for w in items.words])
    ok = weight[data] > 0
    key, count = np.unique(item[ok] * len(weight) + data[ok], return_counts=True)
    return key // len(weight), key % len(weight), _damped(count) * weight[key % len(weight)]


def weights(held: DataFrame, items: Items, kind: str, step: int, span: int, common: float) -> np.ndarray:
    """Inverse frequency of each number over all documents' words; 0 for what is too common, except an item's rarest."""
    m = len(items.known) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m, np.int64)
        for batch in batches:
            for data, _, _ in _rows(batch, kind):
                total += np.bincount(data, minlength=m)
        some = np.flatnonzero(total)
        yield pa.record_batch({"number": pa.array(some), "n": pa.array(total[some])})

    counts, every = np.zeros(m), held.agg(F.sum("n_words")).first()[0] or 0
    # One row for each word of the benchmark.
    for number, n in held.mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n")).collect():
        counts[number] = n
    share = (counts + 1) / max(every, 1)
    idf = np.maximum(0.1, np.log(1 / np.minimum(1, share * step * span)))
    keep = share <= common
    for w in items.words:
        own = np.unique(w)
        keep[own[np.argsort(counts[own], kind="stable")[: 2 * ANSWER]]] = True
    keep[0] = False
    return np.where(keep, idf, 0.0)


def latent_space(held: DataFrame, items: Items, kind: str, weight: np.ndarray, rank: int, size: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF matrix of all passages of `size` words: a randomised range
    finder, one pass.  The items are passages too; they are scaled to the weight of all others together, so
    that the space can tell them apart."""
    m, wide = len(weight), rank + 16
    omega = np.random.default_rng(seed).standard_normal((m, wide)).astype(np.float32) * (weight > 0)[:, None]
    rows_a_block = 256

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, energy, task = np.zeros((m, wide), np.float32), 0.0, TaskContext.get().partitionId()
        for batch in batches:
            for data, first, _ in _rows(batch, kind):
                row, column, value, n, *_ = _cells(data, first, weight, size, 1)
                if n:
                    energy += float((value**2).sum())
                    out = _times(row, column, value, n, omega)
                    order = np.argsort(column, kind="stable")
                    some, back = np.unique(column[order], return_inverse=True)
                    total[some] += _times(back, row[order], value[order], len(some), out)
        for b in range(0, m, rows_a_block):
            part = total[b : b + rows_a_block]
            if part.any():
                yield pa.record_batch({"task": pa.array([task]), "block": pa.array([b], pa.int64()), "part": pa.array([part.tobytes()], pa.binary())})
        yield pa.record_batch({"task": pa.array([task]), "block": pa.array([-1], pa.int64()), "part": pa.array([np.float32(energy).tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["part"])
        return pa.table({"task": table["task"].slice(0, 1), "block": table["block"].slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    y, energy = np.zeros((m, wide)), 0.0
    # (words of the benchmark) x (rank + 16) numbers, whatever the documents.
    sums, tasks = held.mapInArrow(sketch, "task long, block long, part binary"), held._jdf.queryExecution().toRdd().getNumPartitions()
    while tasks > 1:
        sums, tasks = sums.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "block").applyInArrow(add, "task long, block long, part binary"), -(-tasks // FAN)
    for _, block, part in sums.collect():
        if block < 0:
            energy = float(np.frombuffer(part, np.float32)[0])
        else:
            y[block : block + rows_a_block] = np.frombuffer(part, np.float32).reshape(-1, wide)
    row, column, value = _item_cells(items, weight)
    if len(row):
        value = value * np.sqrt(max(energy, 1.0) / (value**2).sum())
        out = np.zeros((len(items.ids), wide))
        np.add.at(out, row, omega[column] * value[:, None])
        np.add.at(y, column, out[row] * value[:, None])
    q, _ = np.linalg.qr(y)
    # Of the projected Gram matrix, from the same pass: S (Q'O) = Q'Y.
    s = np.linalg.lstsq((q.T @ omega).T, (q.T @ y).T, rcond=None)[0].T
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    every = (1 << len(item)) - 1
    row = every
    for w in text:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(item) - row.bit_count()


def _views(sizes: np.ndarray, step: int, span: int) -> list[tuple[int, np.ndarray]]:
    """Steps of the passages and the items compared with them: all at the given size, and those of other lengths near
    their own, by powers of two from half the size on."""
    scale = np.round(np.log2(np.maximum(sizes, 1) / (step * span))).clip(-1).astype(np.int64)
    other = [(max(1, int(step * 2.0**k)), np.flatnonzero((scale == k) & (sizes > 0))) for k in np.unique(scale[sizes > 0]).tolist() if k]
    return [(step, np.arange(len(sizes))), *other]


class Copies:
    """Looks up whole items, word for word, by each item's rarest word."""

    def __init__(self, words: list[np.ndarray], weight: np.ndarray):
        some = [k for k, w in enumerate(words) if len(w)]
        place = np.array([int(np.argmax(weight[words[k]])) for k in some], np.int64)
        rare = np.array([words[k][p] for k, p in zip(some, place.tolist(), strict=True)], np.int64)
        order = np.argsort(rare, kind="stable")
        self.words, self.item, self.place = words, np.array(some, np.int64)[order], place[order]
        self.size = np.array([len(words[k]) for k in some], np.int64)[order]
        self.count = np.bincount(rare, minlength=len(weight))
        self.begin = np.cumsum(self.count) - self.count
        hashes = [self._sums(words[k])[-1] for k in some]
        self.hash = np.array(hashes, np.uint64)[order]

    @staticmethod
    def _sums(data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix(data.astype(np.uint64)) * powers(_NUMBER_BASE, len(data))[: len(data)], out=total[1:])
        return total

    def find(self, data: np.ndarray, first: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, int]]:
        """Document, item and first word of copies, one for each pair of document and item in a run of places."""
        total, shift = self._sums(data), powers(_NUMBER_BASE, len(data))
        where = np.flatnonzero(self.count[data])
        for lo, hi in pieces(self.count[data[where]], most):
            at = where[lo:hi]
            n = self.count[data[at]]
            entry = np.repeat(self.begin[data[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a = np.repeat(at, n) - self.place[entry]
            doc = np.repeat(np.searchsorted(first, at, side="right") - 1, n)
            ok = (a >= first[doc]) & (a + self.size[entry] <= first[doc + 1])
            a, doc, entry = a[ok], doc[ok], entry[ok]
            ok = total[a + self.size[entry]] - total[a] == self.hash[entry] * shift[a]
            a, doc, item = a[ok], doc[ok], self.item[entry[ok]]
            _, one = np.unique(np.stack([doc, item]), axis=1, return_index=True)
            for d, q, x in zip(doc[one].tolist(), item[one].tolist(), a[one].tolist(), strict=True):
                if np.array_equal(data[x : x + len(self.words[q])], self.words[q]):
                    yield d, q, x - int(first[d])


def _matches(held: DataFrame, items: Items, kind: str, weight: np.ndarray, space: np.ndarray, step: int, span: int, cosine: float, subsequence: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("word", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64())])
    row, column, value = _item_cells(items, weight)
    queries = np.zeros((len(items.ids), space.shape[1]))
    np.add.at(queries, row, space[column] * value[:, None])
    queries = _unit(queries).astype(np.float32)
    telling = [w[weight[w] > 0] for w in items.words]
    answers = [set(np.unique(w)[np.argsort(-weight[np.unique(w)], kind="stable")[:ANSWER]].tolist()) for w in items.words]
    listed = [w.tolist() for w in items.words]
    views = []
    for pace, some in _views(np.array([len(w) for w in listed], np.int64), step, span):
        views.append((pace, some.tolist(), queries[some], Telling(items.words, some, answers, weight, pace * span)))
    copies = Copies(items.words, weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], [], []]
            for data, first, base in _rows(batch, kind):
                best: dict[tuple[int, int], tuple] = {}
                for pace, some, asked, index in views:
                    for near_by, k in index.pairs(data, first, pace):
                        wanted = np.zeros(int((-(-np.diff(first) // pace)).sum()), bool)
                        wanted[near_by] = True
                        row, column, value, n, owner, word, window = _cells(data, first, weight, pace, span, wanted)
                        if not n:
                            continue
                        passages = _unit(_times(row, column, value, n, space))
                        # A window without a weighted word has no passage.
                        p = np.minimum(np.searchsorted(window, near_by), n - 1)
                        there = window[p] == near_by
                        p, k = p[there], k[there]
                        scores = np.einsum("ij,ij->i", passages[p], asked[k])
                        ok = np.flatnonzero(scores >= cosine)
                        for p, k, cos in zip(p[ok].tolist(), k[ok].tolist(), scores[ok].tolist(), strict=True):
                            q, at, doc = some[k], int(word[p]), int(owner[p])
                            item = listed[q]
                            lo = max(int(first[doc]), int(first[doc]) + at - len(item))
                            near = data[lo : min(int(first[doc + 1]), int(first[doc]) + at + pace * span + len(item))]
                            answered = len(answers[q].intersection(near.tolist())) * 2 > len(answers[q])
                            needed = subsequence if answered else max(subsequence, REPLACED[1])
                            if not answered and (cos < REPLACED[0] or len(item) < SHORTEST or np.isin(telling[q], near).sum() < REPLACED[2] * len(telling[q])):
                                continue
                            share = common_subsequence(item, near.tolist()) / len(item)
                            if share >= needed and share > best.get((doc, q), (0.0,))[0]:
                                best[doc, q] = (share, at, cos)
                for doc, q, at in copies.find(data, first):
                    # A passage of the copied words alone is the item.
                    if best.get((doc, q), (0.0,))[0] < 1:
                        best[doc, q] = (1.0, at, 1.0)
                for (doc, q), (share, at, cos) in best.items():
                    for c, v in zip(out, (batch.column("doc_id")[base + doc].as_py(), batch.column("text_hash")[base + doc].as_py(), items.ids[q], at, cos, share), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return held.select("doc_id", "text_hash", "numbers").mapInArrow(run, "doc_id long, text_hash long, item_id long, word long, cosine double, common double")


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, step: int = STEP, span: int = SPAN, cosine: float = COSINE, common: float = COMMON, subsequence: float = SUBSEQUENCE, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, item_id, word (where the best passage begins), cosine, common (share of the item's words in order)."""
    spark = docs.sparkSession
    ship(spark)
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").orderBy("item_id", "text")
    found, part = None, []

    def work(part: list) -> DataFrame:
        items = Items([r[0] for r in part], [r[1] for r in part])
        kind = "<u2" if len(items.known) < (1 << 16) - 1 else "<u4"
        held = written(numbered(docs, items), "numbered")
        weight = weights(held, items, kind, step, span, common)
        space = latent_space(held, items, kind, weight, min(rank, max(1, len(items.known))), step * span)
        return _matches(held, items, kind, weight, space, step, span, cosine, subsequence)

    for r in rows.toLocalIterator():
        if len(part) == block:
            found = work(part) if found is None else found.unionByName(work(part))
            part = []
        part.append(r)
    last = work(part) if part or found is None else None
    return last if found is None else found.unionByName(last) if last is not None else found


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds, as sorted ids."""
    docs = load(spark, sf_dir, "documents")
    found = contaminated(docs, load(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("common").alias("common"), F.max("cosine").alias("cosine"))
