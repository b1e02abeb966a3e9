"""MinHash near-dedup by a multi-index Hamming join, links confirmed on full sets.

1. Each text becomes its set of word shingles and a signature: 36 minhash values
   of 16 bits.  Texts with equal sets form one class from here on.
2. Signatures are cut into 9 chunks of 4 values.  Two signatures that differ in
   at most 17 values differ in at most 1 value of some chunk (pigeonhole), so
   every chunk is looked up with each set of 1 value left out: all pairs within
   the distance meet in some bucket.  For a similarity of 0.8 the number of
   differing values is binomial (36, 0.2); over 17 has a chance of about 3 in
   100,000 at exactly 0.8, and such a pair is only lost if no chain of other
   pairs joins its group.
3. A bucket emits a spanning forest of its pairs within the distance, not its
   pairs; a bucket over BLOCK rows emits a star.  Components of these edges are
   candidate groups; they are supersets of the true ones.
4. In each candidate group the full sets are compared exactly.  A group that fits
   into a block, by members and by shingles, is one comparison.  A larger one is
   dealt into blocks; each block's confirmed links make components, and one member of
   each is dealt again and compared with those of other blocks, until that joins
   little more.  Then only members outside of the group's largest component are
   compared with all members, block by block: links within a component add nothing,
   so none between different components is lost.  A group of near copies is thus sent
   a few times, not once for each block.
5. Each comparison emits a spanning forest of its links; their components are the
   result.

Shingles are 64-bit identifiers of whole word sequences, classes of equal sets are
told apart by 128 bits.  Sets of one text are held whole, so a very long text needs
some 100 bytes of one task's memory for each of its words.

Defined results: null or blank texts have an empty set and link with nothing;
texts with fewer words than a shingle have their whole sequence as one shingle; an
empty table gives no rows.  Rows of equal text share a class whatever their ids; a
null doc_id counts as larger than any other.  A similarity just at the bound links.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, load, matching, ship, shuffle_partitions, text_hash, written
from .components import components, split_join
from .textscan import LOWER, U64, mix, pieces, span_hashes, text_bytes, windows, words

VALUES, CHUNKS, DISTANCE = 36, 9, 17
#: Members of a block at most, and their shingles on average.
BLOCK, SHINGLES = 1500, 2_000_000
#: Members of candidate groups, nine numbers each, that may be sent to every executor: some 40 MB at most.
FEW_MEMBERS = 250_000
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * U64(2) + U64(1)


def _pack(values: np.ndarray) -> bytes:
    """Sorted values as differences, a plane for each byte."""
    gaps = np.diff(values, prepend=U64(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(block: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(8, -1).T).view(U64).ravel())


def shingle_sets(column: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """For runs of rows, each row's sorted set of shingle identifiers."""
    raw, at = text_bytes(column)
    for a, b in pieces(np.diff(at)):
        part, rows = LOWER[raw[at[a] : at[b]]], at[a : b + 1] - at[a]
        start, end, first = words(part, rows)
        codes = span_hashes(part, start, end)
        hashes = windows(codes, size)
        sets = []
        for row in range(b - a):
            lo, hi = int(first[row]), int(first[row + 1])
            if hi - lo >= size:
                sets.append(np.unique(hashes[lo : hi - size + 1]))
            elif hi > lo:
                sets.append(mix(windows(codes[lo:hi], hi - lo) + U64(hi - lo)))
            else:
                sets.append(np.zeros(0, U64))
        yield sets


def signatures(sets: list[np.ndarray], values: int = VALUES) -> np.ndarray:
    """Minhash values of 16 bits, a row for each set; the sets aren't empty."""
    every = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), values), np.uint16)
    for k in range(values):
        x = (every ^ _SEEDS[0, k]) * _SEEDS[1, k]
        x ^= x >> U64(29)
        out[:, k] = (mix(np.minimum.reduceat(x * _SEEDS[1, k - 1], at)) & U64(0xFFFF)).astype(np.uint16)
    return out


def shingle_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cid and check (128 bits of the class of equal sets; null if empty), signature, shingles."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("cid", pa.int64()), ("check", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for sets in shingle_sets(batch.column(1), size):
                some = [s for s in sets if len(s)]
                sigs = iter(signatures(some)) if some else iter(())
                rows = [[], [], [], [], []]
                for s in sets:
                    if len(s):
                        name = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                        row = (len(s), *name, next(sigs).tobytes(), _pack(s))
                    else:
                        row = (0, None, None, None, None)
                    for c, v in zip(rows, row, strict=True):
                        c.append(v)
                yield pa.record_batch([batch.column(0).slice(done, len(sets)), batch.column(2).slice(done, len(sets)), *(pa.array(c, f.type) for c, f in zip(rows, list(schema)[2:], strict=True))], schema=schema)
                done += len(sets)

    return docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("h")).mapInArrow(scan, "doc_id long, text_hash long, n_shingles long, cid long, check long, signature binary, shingles binary")


def _keys(classes: DataFrame, chunks: int, distance: int) -> DataFrame:
    """A row for each chunk of a signature and each set of allowed errors in it: key, cid, and the signature's low bytes."""
    schema = pa.schema([("key", pa.int64()), ("cid", pa.int64()), ("low", pa.binary())])
    errors = distance // chunks

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, VALUES)
            low = np.ascontiguousarray(sig.astype(np.uint8)).tobytes()
            ends = pa.py_buffer((np.arange(n + 1) * VALUES).astype(np.int32).tobytes())
            for c, columns in enumerate(np.array_split(np.arange(VALUES), chunks)):
                for j, left in enumerate(combinations(range(len(columns)), errors)):
                    key = np.full(n, c * 1000 + j, U64)
                    for x in np.delete(columns, left):
                        key = mix(key ^ (sig[:, x].astype(U64) + U64(0x9E3779B97F4A7C15)))
                    yield pa.record_batch([pa.array(key.view(np.int64)), batch.column(0), pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(low)])], schema=schema)

    return classes.select("cid", "signature").mapInArrow(emit, "key long, cid long, low binary")


def _forest(near: np.ndarray) -> np.ndarray:
    """Of a symmetric link matrix: each row's least reachable row."""
    n = len(near)
    label = np.arange(n)
    while True:
        best = np.minimum(label, np.where(near, label[None, :], n).min(1))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _bucket_edges(batches: Iterator[pa.RecordBatch], distance: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key.  Of each key's rows: a forest of the pairs within the distance, or a star if there are over `block`."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def close(key_ids: np.ndarray, low: np.ndarray, out: set) -> None:
        near = np.zeros((len(low), len(low)), bool)
        for a in range(0, len(low), 128):
            near[a : a + 128] = (low[a : a + 128, None, :] != low[None, :, :]).sum(2) <= distance
        label = _forest(near)
        out.update((int(key_ids[i]), int(key_ids[j])) for i, j in enumerate(label.tolist()) if i != j)

    held_key, ids, low, star = None, np.zeros(0, np.int64), np.zeros((0, VALUES), np.uint8), None
    for batch in batches:
        out: set = set()
        keys = batch.column(0).to_numpy()
        cids = batch.column(1).to_numpy()
        lows = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(keys), VALUES)
        if not len(keys):
            continue
        cut = np.flatnonzero(np.diff(keys)) + 1
        begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        if held_key is not None and keys[0] != held_key:
            if star is None and len(ids) > 1:
                close(ids, low, out)
            held_key, star = None, None
        pairs = np.flatnonzero((ends - begins == 2)[1:-1]) + 1  # runs of two that end in this batch, all at once
        if len(pairs):
            a = begins[pairs]
            ok = (lows[a] != lows[a + 1]).sum(1) <= distance
            out.update(zip(cids[a[ok]].tolist(), cids[a[ok] + 1].tolist(), strict=True))
        many = [0, *(np.flatnonzero((ends - begins > 2)[1:-1]) + 1).tolist(), len(begins) - 1]
        for r in dict.fromkeys(many):
            a, b = int(begins[r]), int(ends[r])
            if held_key is None:
                held_key, ids, low, star = keys[a], cids[a:b], lows[a:b], None
            elif star is None:
                ids, low = np.concatenate([ids, cids[a:b]]), np.concatenate([low, lows[a:b]])
            else:
                ids = cids[a:b]
            if star is None and len(ids) > block:
                star = int(ids[0])
            if star is not None:
                out.update((star, int(x)) for x in ids)
                ids, low = ids[:0], low[:0]
            if b < len(keys):  # the run ends here
                if star is None and len(ids) > 1:
                    close(ids, low, out)
                held_key, star = None, None
        if out:
            u, v = zip(*out, strict=True)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)
    if held_key is not None and star is None and len(ids) > 1:
        out = set()
        close(ids, low, out)
        if out:
            u, v = zip(*out, strict=True)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)


def confirmed(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None, columns: int = 4096) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union; with `left`, only pairs that have one of these."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    keep = count[inverse] > 1
    owner, column = owner[keep], new[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((n, n), np.float32)
    for c in range(0, int(count.size and (count > 1).sum()), columns):
        a, b = np.searchsorted(column, [c, c + columns])
        part = np.zeros((n, columns), np.float32)
        part[owner[a:b], column[a:b] - c] = 1
        inter += part @ part.T
    inter = np.rint(inter).astype(np.int64)
    near = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    if left is not None:
        near &= left[:, None] | left[None, :]
    np.fill_diagonal(near, True)
    return near


def _confirm(table: pa.Table, percent: int) -> pa.Table:
    """Links of one task's groups: those between two blocks, or those within one."""
    out = []
    gid, bi, bj = (table[c].to_numpy() for c in ("gid", "bi", "bj"))
    cids, own, sets = table["cid"].to_numpy(), table["block"].to_numpy(), table["shingles"]
    order = np.lexsort((-own, bj, bi, gid))
    cut = np.flatnonzero((np.diff(gid[order]) != 0) | (np.diff(bi[order]) != 0) | (np.diff(bj[order]) != 0)) + 1
    for rows in np.split(order, cut):
        # A member that stands on both sides counts on the first.
        _, one = np.unique(cids[rows], return_index=True)
        rows = rows[one]
        if len(rows) < 2:
            continue
        near = confirmed([_unpack(sets[int(r)].as_py()) for r in rows], percent, own[rows] == -1 if own[rows[0]] < 0 else None)
        out += [(int(cids[rows[i]]), int(cids[rows[j]])) for i, j in enumerate(_forest(near).tolist()) if i != j]
    return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})


def _compared(full: DataFrame, task, percent: int) -> DataFrame:
    """Links between members of equal (gid, bi, bj)."""
    return full.select(task.alias("task"), "gid", "bi", "bj", "block", "cid", "shingles").groupBy("task").applyInArrow(lambda t: _confirm(t, percent), "u long, v long")


def _blocks(members: DataFrame, seed: int, block: int, weight: int) -> DataFrame:
    """Members dealt into blocks of their group (gid), by a hash of the class: as many as members and shingles ask for."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / weight)).cast("int")
    sizes = members.groupBy("gid").agg(parts.alias("parts"), F.count(F.lit(1)).alias("n"))
    out = split_join(members, sizes.select("gid", "parts"), "gid", sizes.select("gid", "n"), members.count())
    return out.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(seed)), F.col("parts")).cast("int"))


def _own(dealt: DataFrame) -> DataFrame:
    return dealt.withColumns({"bi": F.col("block"), "bj": F.col("block")})


def confirmed_links(members: DataFrame, held: DataFrame, percent: int, block: int, weight: int) -> DataFrame:
    """A forest of the confirmed links of all candidate groups: members (cid, of and check, rep, n_shingles, gid)."""
    dealt = written(_blocks(members, 0, block, weight), "members")
    one = held.select(F.col("doc_id").alias("rep_"), F.col("cid").alias("of_"), F.col("check").alias("check_"), "shingles")
    # Beyond the bound the join shuffles every document's shingles.
    full = (F.broadcast(dealt) if dealt.count() <= FEW_MEMBERS else dealt).join(one, (F.col("of") == F.col("of_")) & (F.col("check") == F.col("check_")) & F.col("rep").eqNullSafe(F.col("rep_")))
    rows, shingles = dealt.where("parts = 1").agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    few = max(4, -(-rows // 2000), -(-shingles // weight))
    links = _compared(_own(full.where("parts = 1")), F.pmod(F.xxhash64("gid"), F.lit(few)), percent)
    if dealt.where("parts > 1").isEmpty():
        return links
    return links.unionByName(_large_groups(written(full.where("parts > 1").select("cid", "gid", "n_shingles", "shingles").dropDuplicates(["cid"]), "large"), percent, block, weight))


def _large_groups(full: DataFrame, percent: int, block: int, weight: int) -> DataFrame:
    """Links of groups that do not fit into one block: (cid, gid, n_shingles, shingles), one row for each class."""
    members, bodies, task = full.drop("shingles"), full.select("cid", "shingles"), F.xxhash64("gid", "bi", "bj")
    here, left, found, rows = members, None, None, members.count()
    for seed in range(1, 20):
        mine = written(_own(_blocks(here, seed, block, weight)), "dealt", rows)
        more = _compared(mine.join(bodies, "cid"), task, percent)
        found = written(more if found is None else found.unionByName(more), "found")
        label = components(found).select(F.col("node").alias("cid"), "label")
        told = written(members.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "told", rows)
        # One member of each component goes on; where that hardly makes them fewer, the last step finds the rest.
        here = told.where("cid = label").drop("label")
        before, left = left, here.count()
        if mine.where("parts > 1").isEmpty() or (before is not None and left * 2 > before):
            break
    sizes = told.groupBy("gid", "label").agg(F.count(F.lit(1)).alias("k"))
    best = sizes.groupBy("gid").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    counts = told.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    told = written(split_join(told, best, "gid", counts, rows), "main", rows)
    lone = written(_blocks(told.where("label <> main"), 30, block, weight), "lone", rows)
    if lone.isEmpty():
        return found
    every = written(_blocks(told.join(F.broadcast(lone.select("gid").distinct()), "gid", "left_semi"), 31, block, weight), "every", rows)
    number = lambda df: F.broadcast(df.groupBy("gid").agg(F.first("parts").alias("others")))  # noqa: E731  a row for each group over a block
    side = lambda df, other, mine, its, mark: df.join(number(other), "gid").withColumn(its, F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select("cid", "gid", F.col("block").alias(mine), its, F.lit(mark).alias("block"))
    both = side(lone, every, "bi", "bj", -1).unionByName(side(every, lone, "bj", "bi", -2))
    return found.unionByName(_compared(both.join(bodies, "cid"), task, percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, chunks: int = CHUNKS, distance: int = DISTANCE, block: int = BLOCK, weight: int = SHINGLES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (least doc_id of the group), kept, label (names the group; null for an
    empty set): one row for each document."""
    spark = docs.sparkSession
    sets = written(shingle_table(docs, size), "shingles")
    held = sets.where("cid is not null")
    sums = held.groupBy("cid", "check").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n"))
    # Classes that share 64 of their 128 bits: all but the first are named by both halves.
    nth = F.row_number().over(Window.partitionBy("cid").orderBy("check"))
    classes = written(sums.withColumn("name", F.when(nth == 1, F.col("cid")).otherwise(F.xxhash64("cid", "check"))), "classes")
    named = classes.select(F.col("name").alias("cid"), "signature")
    buckets = _keys(named, chunks, distance).repartition(max(shuffle_partitions(spark), 8), "key").sortWithinPartitions("key")
    edges = buckets.mapInArrow(lambda b: _bucket_edges(b, distance, block), "u long, v long")
    groups = components(edges).select(F.col("node").alias("name"), F.col("label").alias("gid"))
    members = written(groups.join(classes, "name").select(F.col("name").alias("cid"), F.col("cid").alias("of"), "check", "rep", "n_shingles", "gid"), "groups")
    links = confirmed_links(members, held, percent, block, weight)
    joined = components(links)

    reps = classes.select("name", "cid", "check", "rep", "n").join(joined.select(F.col("node").alias("name"), "label"), "name", "left").withColumn("label", F.coalesce("label", "name"))
    least = reps.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_class = split_join(reps.drop("n"), least.select("label", "component_id"), "label", least.select("label", "n"), classes.count())
    many = written(of_class.select(F.struct("cid", "check").alias("class"), "component_id", "label"), "of_class")
    counts = classes.select(F.struct("cid", "check").alias("class"), "n")
    rows = sets.select("doc_id", "text_hash", "n_shingles", F.when(F.col("cid").isNotNull(), F.struct("cid", "check")).alias("class"))
    out = split_join(rows, many, "class", counts, sets.count(), "left")
    out = out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "label")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all of their columns: one row of each group of near duplicates, that of least doc_id (null last),
    then of least text hash; of rows equal in both, one.  Rows without words stay."""
    found = written(near_duplicates(docs, **options).where("label is not null").select("doc_id", "text_hash", "label"), "near")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("label").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    told = split_join(found, first.select("label", "first"), "label", first.select("label", "n"), found.count())
    kept = matching(docs, told.where(~place.eqNullSafe(F.col("first"))), "left_anti")
    twice = written(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash"), "twice")
    if twice.isEmpty():
        return kept
    name = fresh(docs.columns, "text_hash")
    once = matching(kept, twice, "left_semi").withColumn(name, text_hash()).dropDuplicates(["doc_id", name]).drop(name)
    return matching(kept, twice, "left_anti").unionByName(once)


def op8_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), size=4).select("doc_id", "n_shingles", "component_id", "kept")


#: Sets of 4-word shingles as lists, links by their exact similarity, and every document's least reachable id.
ORACLE = r"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  cut AS (SELECT r, unnest(w) AS a, unnest(range(0, len(w))) AS p, len(w) AS n FROM texts),
  grams AS (SELECT r, p, n, CASE WHEN n >= 4 THEN concat_ws(' ', a, lead(a, 1) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o) ELSE string_agg(a, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS g FROM cut WINDOW o AS (PARTITION BY r ORDER BY p)),
  sets AS MATERIALIZED (SELECT DISTINCT r, g FROM grams WHERE p <= greatest(n - 4, 0)),
  sizes AS MATERIALIZED (SELECT r, count(*) AS k FROM sets GROUP BY r),
  links AS MATERIALIZED (SELECT a.r AS x, b.r AS y FROM sets a JOIN sets b ON a.g = b.g AND a.r <> b.r JOIN sizes s ON s.r = a.r JOIN sizes t ON t.r = b.r GROUP BY a.r, b.r, s.k, t.k HAVING 100 * count(*) >= 80 * (s.k + t.k - count(*))),
  reach AS (SELECT r AS x, r AS y FROM texts UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT o.doc_id, coalesce(k, 0) AS n_shingles, c AS component_id, o.doc_id = c AS kept FROM (SELECT x, min(doc_id) AS c FROM reach JOIN texts ON texts.r = y GROUP BY x) g JOIN texts o ON o.r = x LEFT JOIN sizes ON sizes.r = x"""
