"""Which keys occurred earlier?  A two-way shuffle of sorted key blocks.

Documents are dealt into groups by ranges of doc_id that hold about as many bytes
each, so that group numbers follow document order.  Each group sends its
*distinct* keys once, sorted and delta-coded, in one block for each bucket of the
key space.  A bucket's task sees every group's block and returns some bits for each
key.  A key that a third of all documents share is sent once by each group, so no
task depends on how often a key occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GROUP_BYTES, group_bytes, ship, shuffle_partitions, written
from .textscan import U64

KEYS = T.StructType([T.StructField("bid", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("block", T.BinaryType())])
ARROW_KEYS = pa.schema([("bid", pa.int32()), ("bucket", pa.int32()), ("level", pa.int32()), ("block", pa.binary())])
_ORDER = ["o", "d", "h"]  # without an id, id, hash of the text


def _cuts(sizes: DataFrame, target: int, parts: int) -> list[tuple[int, int, int]]:
    """Where groups begin, the first aside: rows (o, d, h) such that each group has about `target` bytes or is one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, out = 0, None, []
        for batch in batches:
            for o, d, h, n in zip(*(batch.column(c).to_pylist() for c in ("o", "d", "h", "n")), strict=True):
                if last is None or (held + n > target and (o, d, h) != last):
                    out.append((o, d, h))
                    held = 0
                held, last = held + n, (o, d, h)
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=_ORDER)

    ranged = sizes.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    # One row for each `target` bytes of text, and for each partition.
    return sorted(tuple(r) for r in ranged.mapInArrow(run, "o int, d long, h long").collect())[1:]


def _number(cuts: list[tuple[int, int, int]], own: list[Column]) -> Column:
    """How many cuts are at or below a row's key: a binary search in arrays that the plan holds once."""
    if not cuts:
        return F.lit(0)
    o, d, h = (F.split(F.lit(",".join(map(str, c))), ",").cast("array<bigint>") for c in zip(*cuts, strict=True))

    def step(acc: Column, jump: Column) -> Column:
        at = acc + jump
        k = F.least(at, F.lit(len(cuts))) - 1
        below = (F.get(o, k) < own[0]) | ((F.get(o, k) == own[0]) & ((F.get(d, k) < own[1]) | ((F.get(d, k) == own[1]) & (F.get(h, k) <= own[2]))))
        return F.when((at <= len(cuts)) & below, at).otherwise(acc)

    jumps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), step)


def by_range(docs: DataFrame, most: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """bid, doc_id, text, h, dealt out by bid, a group number that grows with doc_id; and how many there may be.

    Rows without an id come last.  Rows of one id are ordered by a hash of their text, so that an id that many rows
    share is spread over groups like any others; only rows equal in both, or one long text, may exceed a group's size.
    Sizes are summed over the texts themselves, whatever the plan's statistics say.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = [F.col("doc_id").isNull().cast("int"), F.coalesce("doc_id", F.lit(0)).cast("long"), F.col("h")]
    sizes = written(rows.select(*(c.alias(n) for n, c in zip(_ORDER, own, strict=True)), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")), "sizes")
    total, count = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    target = group_bytes(total, shuffle_partitions(spark), most)
    cuts = _cuts(sizes, target, max(1, -(-count // 1_000_000)))
    n = len(cuts) + 1
    kept = rows.select(_number(cuts, own).cast("int").alias("bid"), "doc_id", "text", "h")
    return kept.repartition(n, "bid"), n


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, one plane for each byte, so that the shuffle's compression drops the empty planes."""
    gaps = keys.copy()
    gaps[1:] = keys[1:] - keys[:-1]
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(block: bytes, extra: np.dtype | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """A block's keys, and what goes with each."""
    n = len(block) // (8 + (extra.itemsize if extra else 0))
    planes = np.frombuffer(block, np.uint8, 8 * n).reshape(8, -1)
    keys = np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel())
    return keys, np.frombuffer(block, extra, n, 8 * n) if extra else None


def unpack_all(blocks: list[bytes], extra: np.dtype | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """The keys of all blocks one after the other, what goes with them, and where each block begins."""
    parts = [unpack(b, extra) for b in blocks]
    keys = np.concatenate([np.zeros(0, U64), *(k for k, _ in parts)])
    more = np.concatenate([np.zeros(0, extra), *(x for _, x in parts)]) if extra else None
    return keys, more, np.cumsum([0, *(len(k) for k, _ in parts)])


def cut_points(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys, one more at the end."""
    return np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))


def key_blocks(bid: int, keys: np.ndarray, buckets: int, level: int = 0, extra: np.ndarray | None = None) -> pa.Table:
    """One row for each bucket that has keys; `extra` (same order) follows the keys in a block."""
    at = cut_points(keys, buckets)
    full = np.flatnonzero(np.diff(at))
    blocks = [pack(keys[at[b] : at[b + 1]]) + (extra[at[b] : at[b + 1]].tobytes() if extra is not None else b"") for b in full]
    n = len(full)
    return pa.table({"bid": pa.array(np.full(n, bid, np.int32)), "bucket": pa.array(full.astype(np.int32)), "level": pa.array(np.full(n, level, np.int32)), "block": pa.array(blocks, pa.binary())}, schema=ARROW_KEYS)


def answer(blocks: DataFrame, decide: Callable, buckets: int) -> DataFrame:
    """Bring each bucket's blocks together; `decide(list of blocks in group order)` gives each block's answer."""

    def bucket(table: pa.Table) -> pa.Table:
        bids = np.asarray(table["bid"])
        order = np.argsort(bids, kind="stable")
        blocks = table["block"].to_pylist()
        replies = decide([blocks[k] for k in order])
        return pa.table({"bid": pa.array(bids[order]), "bucket": table["bucket"].take(pa.array(order)), "level": table["level"].take(pa.array(order)), "block": pa.array(replies, pa.binary())}, schema=ARROW_KEYS)

    return blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(bucket, KEYS)


def packed_bits(bits: np.ndarray, at: np.ndarray) -> list[bytes]:
    """One row of bits for each key, cut into blocks."""
    return [np.packbits(bits[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def read_bits(replies: pa.Table, keys: np.ndarray, buckets: int, level: int = 0, per_key: int = 1) -> np.ndarray:
    """The bits of a group's keys, in the order of its sorted keys; per_key bits each, as rows of an array if over 1."""
    at = cut_points(keys, buckets)
    out = np.zeros((len(keys), per_key), bool)
    for b, lvl, block in zip(replies["bucket"].to_pylist(), replies["level"].to_pylist(), replies["block"].to_pylist(), strict=True):
        if lvl == level:
            n = int(at[b + 1] - at[b])
            out[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(block, np.uint8), count=n * per_key).reshape(n, per_key)
    return out[:, 0].astype(bool) if per_key == 1 else out.astype(bool)


def in_order(table: pa.Table) -> pa.Table:
    """Rows by doc_id, null last, ties by hash and text: the same order each time a group is built."""
    texts = table["text"].fill_null("")
    table = table.set_column(table.schema.get_field_index("text"), "text", texts)
    return table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("h", "ascending"), ("text", "ascending")], null_placement="at_end"))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of true flags, and the place behind its last."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the half-open intervals."""
    change = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(last, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0
