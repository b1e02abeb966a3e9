"""Suffix-array dedup of byte strings by bucket-pointer refinement over sampled suffixes.

All 100-byte strings are to be classed, but few suffixes need sorting.  Each
string takes the least of its 32-byte grams (by identifier, leftmost on ties) as
its sample; equal strings sample the same place, and strings that follow one
another mostly share it, so about one suffix in 35 is held, and stands for a run.

1. Identifiers are made as bucket-pointer refinement makes them: eight bytes are
   their own; those of a 2q-gram come from the identifiers of the q-grams at its
   offset and q later, reused from step to step (8, 16, 32, 64), and those of a
   string from its 64-grams at offsets 0 and 36.
2. The samples' grams are the initial buckets.  A bucket's task sorts it by the
   identifiers at its suffixes' earlier and later offsets, as far as the runs
   reach.  What an earlier group has in full is settled, and so is a bucket that
   stays whole.
3. Only where a bucket has fallen apart, the first run of each part is refined
   again, to single strings, settled runs left out, and sorted once more.

Both sorts run on blocks of distinct identifiers (first_seen) and send back bits.
An identifier is a fingerprint of 96 bits, not a rank: ranks would have to be sent
back to every place after each step, some 8 bytes for each byte of text.

Defined results: null is an empty text; texts under 100 bytes keep all, an empty
table gives no rows.  A long text is scanned in one piece by one task, with about
60 bytes of memory for each of its bytes.  Order is doc_id, then place; rows of
equal doc_id are ordered by a hash of their text and so may remove one another's
bytes (of equal rows all but one lose their repeated bytes); rows without doc_id
come last.  Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import GROUP_BYTES, load
from .first_seen import ARROW_KEYS, KEYS, answer, by_range, covered, in_order, key_blocks, packed_bits, read_bits, runs, unpack_all
from .textscan import U64, eights, mix, pair, pieces, text_bytes

WIDTH, GRAM = 100, 32
#: What goes with a bucket: an identifier of 96 bits; with a string's key: the 32 bits that the key lacks.
_ID = np.dtype([("a", "<u8"), ("b", "<u4")])
_REST = np.dtype("<u4")


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _strings(eight: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two identifiers of the strings at some places, from the identifiers of their halves, and so on down to eight bytes."""
    size = 8
    while size * 2 <= width:
        size *= 2
    out = []
    for lane in (0, 1):
        ends = []
        for offset in (0, width - size):
            held = eight[np.arange(offset, offset + size, 8)[:, None] + at[None, :]]
            while len(held) > 1:
                held = pair(held[0::2], held[1::2], lane)
            ends.append(held[0])
        out.append(pair(ends[0], ends[1], lane))
    return out[0], out[1]


def _scan(raw: np.ndarray, rows: np.ndarray, width: int, gram: int):
    """Of one piece of text: runs of strings that share a sample - first and last start, bucket, identifier."""
    n = len(raw)
    starts = n - width + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, _ID)
    eight = mix(eights(raw))
    grams, size = eight[: n - 7], 8
    while size < gram:
        grams = pair(grams[:-size], grams[size:])
        size *= 2
    low = U64((1 << max(1, n.bit_length())) - 1)
    sample = (_least((grams & ~low) | np.arange(len(grams), dtype=U64), width - gram + 1) & low).astype(np.int64)
    ok = np.ones(starts, bool)  # strings within one row
    for end in rows[1:-1]:
        ok[max(0, end - width + 1) : min(end, starts)] = False
    change = np.ones(starts, bool)
    change[1:] = (sample[1:] != sample[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], starts) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    # A run's text is covered by its first and its last string; the sample's place in it counts, too.
    shape = ((last - first) << 16 | (sample[first] - first)).astype(U64)
    head, tail = _strings(eight, first, width), _strings(eight, last, width)
    ids = np.empty(len(first), _ID)
    ids["a"] = pair(pair(head[0], tail[0]), shape)
    ids["b"] = pair(pair(head[1], tail[1], 1), shape, 1) >> U64(32)
    # Samples are least identifiers and so far from even; mixed once more, they fill all buckets alike.
    return first, last, mix(grams[sample[first]] ^ U64(0x5851F42D4C957F2D)), ids


def _sorted(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, identifier and place; which places of the order differ in key, and which in key or identifier, from the one before."""
    a, b = (ids["a"], ids["b"]) if ids.dtype.names else (ids, ids)
    order = np.lexsort((a, keys))

    def steps(order):
        apart, other = np.ones(len(order), bool), np.ones(len(order), bool)
        apart[1:] = keys[order[1:]] != keys[order[:-1]]
        other[1:] = apart[1:] | (a[order[1:]] != a[order[:-1]])
        return apart, other

    apart, other = steps(order)
    rest = np.ones(len(order), bool)
    rest[1:] = other[1:] | (b[order[1:]] != b[order[:-1]])
    if (rest != other).any():  # equal in 64 bits only
        order = np.lexsort((b, a, keys))
        apart, other = steps(order)
        rest[1:] = other[1:] | (b[order[1:]] != b[order[:-1]])
    return order, apart, rest


class _Group:
    """The runs of a group of documents in order; buckets and identifiers sorted as pairs, each distinct pair once."""

    def __init__(self, table: pa.Table, width: int, gram: int):
        self.table = in_order(table)
        self.raw, self.at = text_bytes(self.table["text"])
        self.width = width
        parts = []
        for a, b in pieces(np.diff(self.at)):
            base = self.at[a]
            first, last, bucket, ids = _scan(self.raw[base : self.at[b]], self.at[a : b + 1] - base, width, gram)
            parts.append((first + base, last + base, bucket, ids))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, _ID))
        self.first, self.last, bucket, ids = (np.concatenate(x) for x in zip(none, *parts, strict=True))
        order, _, new = _sorted(bucket, ids)
        self.heads = order[new]  # the first run of each distinct pair
        self.keys, self.ids = bucket[self.heads], ids[self.heads]
        self.member = np.empty(len(order), np.int64)
        self.member[order] = np.cumsum(new) - 1

    def refined(self, seen: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and identifiers of the single strings of unsettled runs, in order."""
        mine = np.sort(self.heads[apart & ~seen])
        out = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, _REST))]
        for a, b in pieces(np.diff(self.at)):
            base, end = self.at[a], self.at[b]
            here = mine[np.searchsorted(self.first[mine], base) : np.searchsorted(self.first[mine], end)]
            if len(here):
                lengths = self.last[here] - self.first[here] + 1
                at = np.repeat(self.first[here] - base - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                eight = mix(eights(self.raw[base:end]))
                for c in range(0, len(at), 1 << 16):
                    one, two = _strings(eight, at[c : c + (1 << 16)], self.width)
                    out.append((at[c : c + (1 << 16)] + base, one, (two >> U64(32)).astype(_REST)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _split(blocks: list[bytes]) -> list[bytes]:
    """Refine buckets by the identifiers at other offsets.  Two bits for each pair: settled by an earlier group; its bucket falls apart."""
    keys, ids, at = unpack_all(blocks, _ID)
    order, apart, other = _sorted(keys, ids)
    bucket = np.cumsum(apart) - 1
    out = np.zeros((len(keys), 2), bool)
    out[order, 0] = ~other
    out[order, 1] = np.bincount(bucket, weights=other)[bucket] > 1 if len(keys) else False
    return packed_bits(out, at)


def _seen(blocks: list[bytes]) -> list[bytes]:
    """For each string a bit: an earlier group has it."""
    keys, rest, at = unpack_all(blocks, _REST)
    order, _, other = _sorted(keys, rest)
    out = np.zeros(len(keys), bool)
    out[order] = ~other
    return packed_bits(out, at)


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed byte runs), kept (the bytes left), kept_sha256."""
    dealt, n = by_range(docs, most)

    def send(table: pa.Table) -> pa.Table:
        g = _Group(table, width, gram)
        return key_blocks(table["bid"][0].as_py(), g.keys, n, extra=g.ids)

    def single(g: _Group, replies: pa.Table):
        """Bits of the runs, and the single strings: starts, order by identifier, which differ from the one before, keys, rest."""
        bits = read_bits(replies, g.keys, n, per_key=2)
        starts, ids, rest = g.refined(bits[:, 0], bits[:, 1])
        order, _, new = _sorted(ids, rest)
        return bits, starts, order, new, ids[order[new]], rest[order[new]]

    def refine(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return ARROW_KEYS.empty_table()
        *_, keys, rest = single(_Group(table, width, gram), replies)
        return key_blocks(table["bid"][0].as_py(), keys, n, level=1, extra=rest)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary()), ("kept_sha256", pa.string())])
        g = _Group(table, width, gram)
        bits, starts, order, new, keys, _ = single(g, replies)
        settled = bits[g.member, 0]
        later = np.ones(len(g.first), bool)
        later[g.heads] = False
        settled |= later  # an equal run came earlier, in this group or another
        again = np.ones(len(starts), bool)
        again[order[new]] = read_bits(replies, keys, n, level=1)
        first, last = np.append(g.first[settled], starts[again]), np.append(g.last[settled], starts[again]) + width
        gone = covered(first, last, len(g.raw))
        out = {c: [] for c in ("n_bytes", "n_removed", "spans", "kept", "kept_sha256")}
        for row in range(len(g.table)):
            text, mask = g.raw[g.at[row] : g.at[row + 1]], gone[g.at[row] : g.at[row + 1]]
            spans, kept = [], text
            if mask.any():
                spans = [[int(s), int(e)] for s, e in zip(*runs(mask), strict=True)]
                kept = text[~mask]
            kept = kept.tobytes()
            for c, v in zip(out, (len(text), int(mask.sum()), spans, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                out[c].append(v)
        return pa.table({"doc_id": g.table["doc_id"], **out}, schema=schema)

    first = answer(dealt.groupBy("bid").applyInArrow(send, KEYS), _split, n)
    second = answer(dealt.groupBy("bid").cogroup(first.groupBy("bid")).applyInArrow(refine, KEYS), _seen, n)
    replies = first.unionByName(second)
    return dealt.groupBy("bid").cogroup(replies.groupBy("bid")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(load(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) n_spans", "kept_sha256")


#: Of bytes as hexadecimal digits, two for each: strings by their digits, a string's first place, removed places, what is left.
ORACLE = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
  parts AS (SELECT r, 64 * c AS base, substring(t, 128 * c + 1, 326) AS u FROM (SELECT r, t, unnest(range(0, len(t) // 128 + 1)) AS c FROM texts)),
  strings AS (SELECT r, base + k AS p, md5(substring(u, 2 * k + 1, 200)) AS s FROM (SELECT r, base, u, unnest(range(0, least(64, len(u) // 2 - 99))) AS k FROM parts WHERE len(u) >= 200)),
  ranked AS (SELECT r, p, row_number() OVER (PARTITION BY s ORDER BY r, p) > 1 AS again FROM strings),
  ends AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 100, true) AS begins FROM ranked WHERE again),
  spans AS (SELECT r, min(p) AS a, max(p) + 100 AS b FROM (SELECT r, p, sum(begins::INT) OVER (PARTITION BY r ORDER BY p) AS g FROM ends) GROUP BY r, g),
  kept AS (SELECT r, string_agg(substring(t, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || max(substring(t, 2 * z + 1)) AS k, sum(b - a) AS m, count(*) AS n
    FROM (SELECT r, t, a, b, coalesce(lag(b) OVER w, 0) AS f, max(b) OVER (PARTITION BY r) AS z FROM spans JOIN texts USING (r) WINDOW w AS (PARTITION BY r ORDER BY a)) GROUP BY r)
SELECT doc_id, (len(t) // 2)::BIGINT AS n_bytes, coalesce(m, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, t))) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)"""
