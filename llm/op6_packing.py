"""Concatenate and cut: documents become one stream of token ids, cut into fixed windows.

Pass 1 encodes each partition's documents once and writes the ids to the shared
folder, each document with the count of ids before it in its partition.  The
partitions' totals - one number each - give prefix sums, so every document's
place in the stream is known.  Pass 2 is row by row: a document's ids are cut
where the stream crosses a window's end, and each cut leaves a boundary record.
Only the last window can be padded; it isn't if its length is a power of two.

The stream's order is that of the scan's partitions and of rows within them; it
is fixed by the table that pass 1 writes, so retried tasks change nothing.

Ids are those of the `tokenizers` library.  Where both libraries provably split
a text alike (Latin letters and common punctuation) `tiktoken` makes them from
the same vocabulary, in a quarter of the time; other texts go to `tokenizers`.

Defined results: a null text is empty and yields its end id alone; repeated rows
are packed as often as they occur; an empty table gives no pieces.  Only doc_id
and text are read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, ship, written

WIDTH, END = 2048, 1
#: Characters on whose classes both libraries agree; tests compare them one by one.
_ODD = re.compile("[^\x00-ſ‐-‧€]")
#: Longer texts are encoded in parts, cut before a single space between two non-blanks, where no token can cross.
LONG = 1 << 20
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


class Encoder:
    """Ids of a tokenizer file, for one process."""

    def __init__(self, path: str, ranks_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.quick, self.special = None, []
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: k for k, t in self.exact.get_added_tokens_decoder().items()}
            self.special = list(special)
            self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def part(self, text: str) -> np.ndarray:
        if self.quick is None or _ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= LONG:
            return self.part(text)
        parts, at = [], 0
        while len(text) - at > LONG:
            cut = _CUT.search(text, at + LONG)
            if not cut:
                break
            parts.append(self.part(text[at : cut.start()]))
            at = cut.start()
        return np.concatenate([*parts, self.part(text[at:])])


def encoded(docs: DataFrame, path: str, ranks_path: str | None, end_id: int) -> DataFrame:
    """part, before, doc_id, n_tokens and ids (little-endian, 32 bits) of each document with its end id."""
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, part = Encoder(path, ranks_path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for a in range(0, len(batch), 512):
                ids = [np.append(encode(t or ""), np.uint32(end_id)) for t in batch.column(1).slice(a, 512).to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                first = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                # 16 bits hold this vocabulary; wider ones are kept whole.
                blocks = [x.astype("<u2").tobytes() if wide == 2 else x.astype("<u4").tobytes() for x in ids]
                yield pa.record_batch([pa.array(np.full(len(ids), part, np.int32)), pa.array(first), batch.column(0).slice(a, 512), pa.array(sizes), pa.array(blocks, pa.binary())], schema=schema)

    wide = vocabulary_bytes(path, end_id)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part int, before long, doc_id long, n_tokens long, ids binary")


def vocabulary_bytes(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def packed(docs: DataFrame, path: str, ranks_path: str | None = None, end_id: int = END, width: int = WIDTH) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, padded_to,
    begins and ends (whether the piece has its document's first and last id), ids (little-endian, 32 bits)."""
    ship(docs.sparkSession)
    wide = vocabulary_bytes(path, end_id)
    held = written(encoded(docs, path, ranks_path, end_id), "ids")
    totals = held.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = totals.agg(F.sum("n").alias("every"))
    places = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")).crossJoin(every)
    # One row of 20 bytes for each input partition; beyond a bound it is joined by shuffling.
    if totals.count() <= 200_000:
        places = F.broadcast(places)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_to", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 512):
                batch = whole.slice(a, 512)
                size = batch.column("n_tokens").to_numpy()
                at = batch.column("base").to_numpy() + batch.column("before").to_numpy()
                every = batch.column("every").to_numpy()
                count = (at + size - 1) // width - at // width + 1
                row = np.repeat(np.arange(len(size)), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                seq = (at // width)[row] + nth
                begin = np.maximum(at[row], seq * width)
                end = np.minimum((at + size)[row], (seq + 1) * width)
                filled = np.minimum((seq + 1) * width, every[row]) - seq * width
                ids = batch.column("ids")
                blocks, last, data = [], -1, None
                for r, s, e in zip(row.tolist(), (begin - at[row]).tolist(), (end - at[row]).tolist(), strict=True):
                    if r != last:
                        data, last = np.frombuffer(ids[r].as_buffer(), f"<u{wide}").astype("<u4"), r
                    blocks.append(data[s:e].tobytes())
                columns = [batch.column("doc_id").take(pa.array(row)), begin - at[row], end - begin, size[row], seq, begin - seq * width, np.where(filled & (filled - 1), width, filled), begin == at[row], end == (at + size)[row], pa.array(blocks, pa.binary())]
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=schema)

    return held.join(places, "part").select("doc_id", "before", "n_tokens", "base", "every", "ids").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_to long, begins boolean, ends boolean, ids binary")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed(load(spark, sf_dir, "documents"), *vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")
