"""Substring dedup of long word passages by compacting a De Bruijn graph over word k-mers.

1. A k-mer of 13 words is an edge from its first to its last 12 words.  Each group
   of documents sends its distinct edges to the edges' buckets (first_seen); back
   comes which of them another group has.  Edges of two documents or more are the
   repeated graph.
2. Each group sends its nodes there, each with the one way that all of its
   documents pass it; back comes where the graph branches, or where any document's
   run of repeated edges begins or ends.  All other nodes have one edge in and one
   out, whoever passes them.
3. Runs are cut at those nodes.  What is left are the nonbranching paths, each a
   passage that every document which has an edge of it holds whole.  A path is named
   by a digest of its words; each group emits its distinct paths with the
   coordinates of their first occurrence, one Spark aggregation finds the first of
   all, and a join brings it back to every group that has the path.
4. A path's words go where its source lies in an earlier document.  Names are
   digests of the words themselves at both coordinates, so words that differ are
   never removed, whatever the edges' 64-bit identifiers say.

Defined results: a null or blank text has no words; a text of under 13 words
keeps all of them; an empty table gives no rows.  A long text is scanned whole by
one task.  Rows of equal doc_id never remove one another's words; rows without
doc_id come after all others, in the order of a hash of their text.  Repeated rows
give repeated results.  Only doc_id and text are read, so other columns may have any
name.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GROUP_BYTES, load
from .first_seen import ARROW_KEYS, KEYS, answer, by_range, covered, in_order, key_blocks, packed_bits, read_bits, unpack_all
from .textscan import U64, inside_rows, pair, pieces, span_hashes, text_bytes, windows, words

K = 13
#: The way through a node: 48 bits of the word before and the word behind; 0 where there is more than one way, or an end.
_WAY = np.dtype([("low", "<u4"), ("high", "<u2")])


def _shared(blocks: list[bytes]) -> list[bytes]:
    """For each key a bit: another group has it."""
    keys, _, at = unpack_all(blocks)
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return packed_bits(out, at)


def _branching(blocks: list[bytes]) -> list[bytes]:
    """For each node a bit: groups disagree on the way through it, or one has more than one, or an end."""
    keys, way, at = unpack_all(blocks, _WAY)
    way = way["low"].astype(U64) | way["high"].astype(U64) << U64(32)
    order = np.argsort(keys)
    out = np.zeros(len(keys), bool)
    if len(keys):
        ranked, way = keys[order], way[order]
        new = np.ones(len(keys), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        begin = np.flatnonzero(new)
        low = np.minimum.reduceat(way, begin)
        out[order] = ((low == 0) | (low != np.maximum.reduceat(way, begin)))[np.cumsum(new) - 1]
    return packed_bits(out, at)


def row_runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of true flags within a row, and the place behind its last; rows begin at `first`."""
    begin, end = np.ones(len(flags), bool), np.ones(len(flags), bool)
    begin[1:] = ~flags[:-1]
    end[:-1] = ~flags[1:]
    edge = first[:-1][first[:-1] < len(flags)]
    begin[edge] = True
    end[edge[edge > 0] - 1] = True
    return np.flatnonzero(flags & begin), np.flatnonzero(flags & end) + 1


class _Graph:
    """A group's words and edges in document order."""

    def __init__(self, table: pa.Table, k: int):
        self.table, self.k = in_order(table), k
        self.raw, at = text_bytes(self.table["text"])
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(1, np.int64))]
        for a, b in pieces(np.diff(at)):
            part = self.raw[at[a] : at[b]]
            start, end, first = words(part, at[a : b + 1] - at[a])
            parts.append((start + at[a], end + at[a], span_hashes(part, start, end), first[1:] + sum(len(p[0]) for p in parts)))
        self.start, self.end, self.codes, self.first = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids = self.table["doc_id"]
        self.ids, self.no_id = ids.fill_null(0).to_numpy(), np.asarray(ids.is_null())
        step = np.ones(len(ids), bool)
        step[1:] = (self.ids[1:] != self.ids[:-1]) | self.no_id[1:]
        self.rank = np.cumsum(step)  # rows of one doc_id share a rank; rows without one have their own
        self.where = np.flatnonzero(inside_rows(self.first, k)) if len(self.codes) >= k else np.zeros(0, np.int64)
        edges = windows(self.codes, k)[self.where]
        order = np.argsort(edges)
        ranked = edges[order]
        new = np.ones(len(edges), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.keys = ranked[new]
        number = np.cumsum(new) - 1
        self.inverse = np.empty(len(edges), np.int64)
        self.inverse[order] = number
        twin = np.flatnonzero(~new)  # equal to the one before in the sort's order
        rank = np.repeat(self.rank, np.diff(self.first))
        apart = rank[self.where[order[twin]]] != rank[self.where[order[twin - 1]]]
        self.several = np.zeros(len(self.keys), bool)
        self.several[number[twin[apart]]] = True
        # How many gaps before each word are not a single space: where there are none, words stand joined in the text.
        gap = np.ones(len(self.codes), bool)
        gap[1:] = (self.start[1:] != self.end[:-1] + 1) | (self.raw[self.end[:-1]] != 0x20)
        self.gaps = np.cumsum(gap, dtype=np.int32)
        self.data = memoryview(self.raw)

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b - 1 of one row, joined by one space."""
        text = self.data[self.start[a] : self.end[b - 1]].tobytes()
        return text if self.gaps[a] == self.gaps[b - 1] else b" ".join(text.split())

    def row(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1

    def repeated(self, shared: np.ndarray) -> np.ndarray:
        """Which words begin a repeated edge; one place more at the end."""
        out = np.zeros(len(self.codes) + 1, bool)
        out[self.where] = (shared | self.several)[self.inverse]
        return out

    def nodes(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct nodes of the repeated graph, the way through each; where nodes stand, and which each one is."""
        before = np.zeros(len(edge), bool)
        before[1:] = edge[:-1]
        at = np.flatnonzero(edge | before)
        inner = (edge & before)[at]
        way = np.zeros(len(at), U64)
        way[inner] = (pair(self.codes[at[inner] - 1], self.codes[at[inner] + self.k - 1]) >> U64(16)) | U64(1)
        node = windows(self.codes, self.k - 1)[at]
        order = np.argsort(node)
        new = np.ones(len(node), bool)
        new[1:] = node[order[1:]] != node[order[:-1]]
        begin = np.flatnonzero(new)
        which = np.empty(len(node), np.int64)
        which[order] = np.cumsum(new) - 1
        if not len(node):
            return node, way, at, which
        low = np.minimum.reduceat(way[order], begin)
        return node[order[begin]], np.where(low == np.maximum.reduceat(way[order], begin), low, U64(0)), at, which

    def paths(self, edge: np.ndarray, at: np.ndarray, cut: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Nonbranching paths in document order: digest, first word, word behind the last, row.  Every run begins at a cut."""
        ends = np.zeros(len(edge), bool)
        ends[at] = cut
        place = np.flatnonzero(edge)
        begin = np.flatnonzero(ends[place])
        first = place[begin]
        last = first + np.diff(np.append(begin, len(place))) + self.k - 1
        spans = zip(self.start[first].tolist(), self.end[last - 1].tolist(), (self.gaps[first] == self.gaps[last - 1]).tolist(), strict=True)
        names = [hashlib.blake2b(self.data[a:b] if plain else b" ".join(self.data[a:b].tobytes().split()), digest_size=16).digest() for a, b, plain in spans]
        return names, first, last, self.row(first)


def repeated_passages(docs: DataFrame, k: int = K, most: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, spans (start and end word of each removed run), paths (start and end word of each compacted path
    that goes, doc_id and word of its source), n_removed, kept_text, kept_sha256."""
    dealt, n = by_range(docs, most)

    def send(table: pa.Table) -> pa.Table:
        return key_blocks(table["bid"][0].as_py(), _Graph(table, k).keys, n)

    def send_nodes(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return ARROW_KEYS.empty_table()
        g = _Graph(table, k)
        keys, way, _, _ = g.nodes(g.repeated(read_bits(replies, g.keys, n)))
        packed = np.empty(len(way), _WAY)
        packed["low"], packed["high"] = way & U64(0xFFFFFFFF), way >> U64(32)
        return key_blocks(table["bid"][0].as_py(), keys, n, level=1, extra=packed)

    def compacted(g: _Graph, replies: pa.Table):
        edge = g.repeated(read_bits(replies, g.keys, n))
        keys, _, at, which = g.nodes(edge)
        return g.paths(edge, at, read_bits(replies, keys, n, level=1)[which])

    def send_paths(table: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("path", pa.binary()), ("no_id", pa.int32()), ("id", pa.int64()), ("bid", pa.int32()), ("rank", pa.int64()), ("place", pa.int64())])
        if not len(table):
            return schema.empty_table()
        g = _Graph(table, k)
        names, first, _, row = compacted(g, replies)
        one = dict(zip(reversed(names), range(len(names) - 1, -1, -1), strict=True))  # the first place of each
        at = np.fromiter(one.values(), np.int64, len(one))
        row, bid = row[at], table["bid"][0].as_py()
        return pa.table([pa.array(list(one), pa.binary()), pa.array(g.no_id[row].astype(np.int32)), pa.array(g.ids[row]), pa.array(np.full(len(at), bid, np.int32)), pa.array(g.rank[row]), pa.array(first[at] - g.first[row])], schema=schema)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        longs = pa.list_(pa.list_(pa.int64()))
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", longs), ("paths", longs), ("kept_text", pa.string()), ("kept_sha256", pa.string())])
        g = _Graph(table, k)
        names, first, last, row = compacted(g, replies)
        back = text_bytes(replies["block"].filter(pa.compute.equal(replies["level"], 2)))[0].reshape(-1, 33)
        number = lambda c: np.ascontiguousarray(back[:, c : c + 8]).view(">i8").ravel().tolist()
        digests = back[:, :16].tobytes()
        source: dict[bytes, tuple] = {digests[16 * j : 16 * j + 16]: (-1, None if none else doc, place) for j, (none, doc, place) in enumerate(zip(back[:, 16].tolist(), number(17), number(25), strict=True))}
        gone, found = [], [[] for _ in range(len(g.table))]
        base = g.first[row]
        for j, (name, own, none, doc, a, b, r) in enumerate(zip(names, *(x.tolist() for x in (g.rank[row], g.no_id[row], g.ids[row], first - base, last - base, row)), strict=True)):
            s = source.get(name)
            if s is None:
                source[name] = (own, None if none else doc, a)
            elif s[0] < own:
                gone.append(j)
                found[r].append([a, b, s[1], s[2]])
        hidden = covered(first[gone], last[gone], len(g.codes))
        begins, ends = row_runs(hidden, g.first)
        removed = np.diff(np.concatenate([[0], np.cumsum(hidden)])[g.first])
        at = np.searchsorted(begins, g.first).tolist()
        begins, ends = begins.tolist(), ends.tolist()
        out = {"n_removed": removed, "spans": [], "paths": found, "kept_text": [], "kept_sha256": []}
        for r, (low, high) in enumerate(itertools.pairwise(g.first.tolist())):
            spans = list(zip(begins[at[r] : at[r + 1]], ends[at[r] : at[r + 1]], strict=True))
            left = zip([low, *(e for _, e in spans)], [*(b for b, _ in spans), high], strict=True)
            kept = b" ".join(g.joined(a, b) for a, b in left if a < b)
            out["spans"].append([[b - low, e - low] for b, e in spans])
            out["kept_text"].append(kept.decode())
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return pa.table({"doc_id": g.table["doc_id"], "n_words": pa.array(np.diff(g.first)), **out}, schema=schema)

    texts = dealt.groupBy("bid")
    edges = answer(texts.applyInArrow(send, KEYS), _shared, n)
    nodes = answer(texts.cogroup(edges.groupBy("bid")).applyInArrow(send_nodes, KEYS), _branching, n)
    known = edges.unionByName(nodes)
    # Both sides of the join read all columns of the paths, so that one exchange serves both and paths are made once.
    paths = texts.cogroup(known.groupBy("bid")).applyInArrow(send_paths, "path binary, no_id int, id long, bid int, rank long, place long").repartition(n, "path")
    own = F.struct("no_id", "id", "bid", "rank", "place")
    sources = paths.groupBy("path").agg(F.min(own).alias("s"))
    earlier = (F.col("s") < own) & ((F.col("no_id") == 1) | (F.col("s.id") < F.col("id")))
    wide = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    block = F.concat("path", F.unhex(F.lpad(F.hex("s.no_id"), 2, "0")), wide("s.id"), wide("s.place"))
    back = paths.join(sources, "path").where(earlier).select("bid", F.lit(0).alias("bucket"), F.lit(2).alias("level"), block.alias("block"))
    return texts.cogroup(known.unionByName(back).groupBy("bid")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, spans array<array<long>>, paths array<array<long>>, kept_text string, kept_sha256 string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


_NEXT = ", ".join(f"lead(w, {j}) OVER o" for j in range(1, K))
ORACLE = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  cut AS (SELECT r, doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p, len(ws) AS n FROM texts),
  grams AS (SELECT r, doc_id, p, n, md5(concat_ws(' ', w, {_NEXT})) AS g FROM cut WINDOW o AS (PARTITION BY r ORDER BY p)),
  again AS (SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY g) AS f FROM grams WHERE p <= n - {K}) WHERE f < doc_id),
  gone AS (SELECT DISTINCT r, p + k AS p FROM again, range(0, {K}) AS x(k)),
  marked AS (SELECT cut.r, cut.p, w, gone.p IS NOT NULL AS g FROM cut LEFT JOIN gone ON gone.r = cut.r AND gone.p = cut.p),
  summed AS (SELECT r, count(*) FILTER (g) AS m, count(*) FILTER (b) AS s, string_agg(w, ' ' ORDER BY p) FILTER (NOT g) AS k FROM (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY r ORDER BY p), false) AS b FROM marked) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256, coalesce(s, 0) AS n_spans FROM texts LEFT JOIN summed USING (r)"""
