"""A small hard corpus: copies, near copies, shared passages, nulls, blanks, long texts, odd characters, repeated rows."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu".split()
TOXIC = ("vilmor", "grundel")


def word(rnd):
    return "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(2, 4)))


def prose(rnd, n):
    return " ".join(word(rnd) for _ in range(n))


def items(seed=1):
    rnd = random.Random(seed)
    return [(k, prose(rnd, rnd.randint(18, 40))) for k in range(12)] + [(50, None), (51, "")]


def documents(seed=2, n=320):
    rnd = random.Random(seed)
    bench = dict(items())
    passage = prose(rnd, 60)
    out, texts = [], []
    for k in range(n):
        kind = k % 16
        if kind == 3 and texts:
            text = rnd.choice(texts)
        elif kind in (4, 5) and texts:  # a near copy
            w = rnd.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rnd.randrange(len(w))] = word(rnd)
            text = " ".join(w)
        elif kind == 6:
            text = f"{prose(rnd, 30)}\n{passage}\n{prose(rnd, 20)}"
        elif kind == 7:
            text = f"{prose(rnd, 40)} {bench[k % 12]} {prose(rnd, 30)}"
        elif kind == 8:
            text = f"{prose(rnd, 60)} {rnd.choice(TOXIC)} {prose(rnd, 20)}"
        elif kind == 9:
            text = f"{prose(rnd, 30)} token = \"{rnd.getrandbits(160):040x}\" AKIA{'A1B2C3D4E5F6G7H8'} https://a.example.com/x {prose(rnd, 9)}"
        elif kind == 10:
            text = " ".join(f"{word(rnd).upper()}!!" for _ in range(80))
        elif kind == 11:
            text = "\n".join([prose(rnd, 8)] * 12)
        elif kind == 12:
            text = f"Größe é😀 {prose(rnd, 50)} x K Released under the MIT License. {prose(rnd, 3)}"
        elif kind == 13:
            text = prose(rnd, rnd.randint(1, 4))
        else:
            text = prose(rnd, rnd.randint(60, 200))
        texts.append(text)
        out.append((k, text))
    out += [(1000, None), (1001, ""), (1002, "  \n\t "), (1003, prose(rnd, 9000)), (1004, "<|endoftext|> under the mit license")]
    out += [(1005, "x" * 3000), (1006, texts[14]), (1006, texts[14])]
    return out


def labels():
    toxic = {i for i, t in documents() if t and any(x in t for x in TOXIC)}
    junk = {i for i, t in documents() if t and "!!" in t}
    return [(i, int(i not in junk), int(i in toxic)) for i, _ in documents() if i < 1000]


def write(spark, path, docs=None, extra=True, bench=None, marks=None):
    df = spark.createDataFrame(documents() if docs is None else docs, "doc_id long, text string")
    if extra:
        clash = "score kept component_id n_words bid level block cid key rank spans terms predicted y of labels gid node u v part before _text".split()
        df = df.selectExpr("doc_id", "text", "'en' AS lang", "'src0' AS source", "length(text) AS n_chars", *(f"'{c}' AS `{c}`" for c in clash))
    else:
        df = df.selectExpr("doc_id", "text", "'en' AS lang", "'src0' AS source", "cast(length(text) AS long) AS n_chars")
    df.repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items() if bench is None else bench, "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels() if marks is None else marks, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return str(path)
