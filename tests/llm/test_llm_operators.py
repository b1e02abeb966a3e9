"""Each operator's query against brute force on a small hard corpus."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus as c
import numpy as np
import pytest

from llm.registry import ORACLE_SQL, QUERIES


def run(spark, path, prefix):
    name = next(n for n in QUERIES if n.startswith(prefix))
    out = defaultdict(list)
    for r in QUERIES[name](spark, path).collect():
        out[r.doc_id].append(r)
    return out


def ordered():
    return sorted(c.documents(), key=lambda d: (d[0], d[1] or ""))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql_agrees(spark, corpus, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{corpus}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, corpus)
    want = con.sql(ORACLE_SQL[name])
    at = [want.columns.index(x) for x in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_op1_base_phrases(spark, corpus):
    got = run(spark, corpus, "op1_")
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for i, t in c.documents():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(c.LOWER))
        places, found = [], set()
        for label, phrase in phrases.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            found |= {label} if hits else set()
        r = got[i][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)))
        assert found <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op2_repeated_bytes(spark, corpus):
    got, seen = run(spark, corpus, "op2_"), set()
    want = defaultdict(list)
    for i, t in ordered():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i].append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(left)))
    assert {i: sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rs) for i, rs in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert sum(x[1] for rs in want.values() for x in rs) > 5000


def test_op3_benchmark_passages(spark, corpus):
    got = {i: set(rs[0].item_ids) for i, rs in run(spark, corpus, "op3_").items()}
    want = defaultdict(set)
    for i, t in c.documents():
        for k, x in c.items():
            if x and t and x in t:
                want[i].add(k)
    assert want and all(want[i] <= got.get(i, set()) for i in want)
    # Near copies may have lost a word of a passage; everything else is clean.
    near = {i for i, t in c.documents() if t and any(len(set((x or "").split()) & set(t.split())) > 8 for _, x in c.items())}
    assert set(got) <= near


def test_op3_paraphrase(spark, tmp_path):
    import random

    rnd = random.Random(8)
    bench = c.items()
    w = bench[0][1].split()
    edited = [x for k, x in enumerate(w) if k % 6 != 5]  # a sixth of the words gone
    docs = [(k, c.prose(rnd, 150)) for k in range(60)] + [(100, f"{c.prose(rnd, 70)} {' '.join(edited)} {c.prose(rnd, 70)}"), (101, " ".join(reversed(w)))]
    got = run(spark, c.write(spark, tmp_path, docs=docs), "op3_")
    assert list(got) == [100] and got[100][0].item_ids == [0]


def test_op3_copies_among_repeated_words(spark, tmp_path):
    import random

    rnd = random.Random(9)
    bench = [(k, c.prose(rnd, n)) for k, n in enumerate([1, 3, 8, 12, 15, 18, 22, 26, 30, 400] * 4)]
    vocabulary = sorted({w for _, t in bench for w in t.split()})
    docs = []
    for k, t in bench:
        docs.append((k, " ".join([rnd.choice(vocabulary)] * 60 + t.split() + [rnd.choice(vocabulary)] * 60)))
        docs.append((100 + k, t))
    docs += [(200 + k, c.prose(rnd, 100)) for k in range(40)]
    got = run(spark, c.write(spark, tmp_path, docs=docs, bench=bench), "op3_")
    want = {i: {k for k, t in bench if f" {t} " in f" {d} "} for i, d in docs}
    assert all(want[i] <= set(got[i][0].item_ids if i in got else []) for i in want)


@pytest.mark.parametrize("long", [0, 1_200_000])
def test_op3_items_over_one_run(spark, tmp_path, long):
    import random

    from llm.op3_decontaminate import Items

    rnd = random.Random(7)
    texts = [c.prose(rnd, 40) for _ in range(5_000 if not long else 6)]
    if long:
        texts[2] = " ".join([texts[2], "zz " * (long // 3)])
    bench = list(enumerate(texts))
    assert sum(len(t) for t in texts) > 1 << 20
    held = [0, 3, 5] if long else [0, 2_500, 4_999]
    docs = [(k, f"{c.prose(rnd, 60)} {texts[i]} {c.prose(rnd, 60)}") for k, i in enumerate(held)] + [(9, c.prose(rnd, 150))]
    items = Items([k for k, _ in bench], texts)
    assert [len(w) for w in items.words] == [len(t.split()) for t in texts]
    got = run(spark, c.write(spark, tmp_path, docs=docs, bench=bench), "op3_")
    assert all(i in got[k][0].item_ids for k, i in enumerate(held)) and 9 not in got



def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("prefix", "column", "folds", "held"), [("op4_", 1, 3, 1), ("op5_", 2, 5, 0)])
def test_classifiers(spark, corpus, prefix, column, folds, held):
    got = run(spark, corpus, prefix)
    assert set(got) == {i for i, _ in c.documents()}
    for i, rs in got.items():
        for r in rs:
            assert r.held_out == (zlib.crc32(str(i).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    y = {r[0]: r[column] for r in c.labels() if zlib.crc32(str(r[0]).encode()) % folds == held}
    assert len(y) > 50 and auc(np.array([got[i][0].score for i in y]), np.array(list(y.values()))) > 0.95


def test_op5_misspelled_and_quoted():
    from llm.levenshtein import Lexicon
    from llm.op5_toxicity import Scorer

    lex = Lexicon([("grundel", False), ("scazz", True), ("vil", False)])
    assert lex.match("grundel") == (0, "grundel") and lex.match("grundle") is None and lex.match("grunde1") == (1, "grundel")
    assert lex.match("grndel") == (1, "grundel") and lex.match("grunddel") == (1, "grundel") and lex.match("grundelish") is None
    assert lex.match("scazzoni") == (0, "scazz") and lex.match("vils") is None and lex.match("vil") == (0, "vil")
    s = Scorer([("grundel", False)])
    assert s.hits("you grundel you")[0] == [1, 0] and s.hits('he said "you grundel" then')[0] == [0, 1] and s.hits("you grundal")[1] == {"grundel": [1, 0]}


def test_levenshtein_against_distance():
    import random

    from llm.levenshtein import Lexicon, allowed_errors

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rnd = random.Random(4)
    terms = ["abcab", "bcaabc", "ccbabcaba"]
    lex = Lexicon([(t, False) for t in terms])
    for _ in range(3000):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 11)))
        near = min((distance(w, t), t) for t in terms if distance(w, t) <= allowed_errors(t)) if any(distance(w, t) <= allowed_errors(t) for t in terms) else None
        got = lex.match(w)
        assert (got is None) == (near is None) and (got is None or got[0] == near[0]), w


def test_op6_packing(spark, corpus):
    from tokenizers import Tokenizer

    from llm.op6_packing import vocabulary

    tk = Tokenizer.from_file(vocabulary()[0])
    got = run(spark, corpus, "op6_")
    texts = defaultdict(list)
    for i, t in c.documents():
        texts[i].append(t)
    places = defaultdict(list)
    for i, ts in texts.items():
        ids = [*tk.encode(ts[0] or "", add_special_tokens=False).ids, 1]
        rows = sorted(got[i], key=lambda r: r.start)
        assert sum(r.length for r in rows) == len(ids) * len(ts)
        for r in rows:
            piece = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.length > 0
            places[r.sequence_id].append((r.offset, r.length))
    for q in range(len(places)):
        at = 0
        for offset, length in sorted(places[q]):
            assert offset == at
            at += length
        assert at == 2048 or q == len(places) - 1


def test_op6_quick_ids_equal_exact_ones():
    from llm import op6_packing as p

    e = p.Encoder(*p.vocabulary())
    for cp in [*range(0x180), *range(0x2010, 0x2028), 0x20AC]:
        ch = chr(cp)
        for t in (f"a{ch}b", f"a {ch} b", f"{ch}{ch}1", f" {ch}\n", f"x{ch}  {ch}'s"):
            if not p._ODD.search(t):
                assert list(e.quick.encode_ordinary(t)) == e.exact.encode(t, add_special_tokens=False).ids, hex(cp)
    import random

    text = c.prose(random.Random(1), 400)
    p.LONG, keep = 500, p.LONG
    try:
        assert list(e(text)) == e.exact.encode(text, add_special_tokens=False).ids
    finally:
        p.LONG = keep


def test_op7_base_spans(spark, corpus):
    got = run(spark, corpus, "op7_")
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    linked = 0
    for i, t in c.documents():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= n)
        text = ",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in spans)
        r = got[i][0]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)] and r.base_sha256 == sha(text)
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        linked += "endpoint:" in r.spans
    assert linked


def test_op7_redaction_and_clashes(spark, corpus):
    from llm.op7_secrets import redacted

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    out = redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = " ".join(r.text or "" for r in out.select("text").collect())
    assert "AKIA" not in text and "[SECRET]" in text and out.where("text is null").count() == 1


def shingles(t, size):
    w = c.WORD.findall((t or "").translate(c.LOWER))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def groups(docs, size):
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op8_near_duplicates(spark, corpus):
    got = run(spark, corpus, "op8_")
    want = groups(c.documents(), 4)
    for i, rs in got.items():
        for r in rs:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[i], want[i][1] == i)
    assert sum(i != root for i, (_, root) in want.items()) > 15


def test_op8_blocks_and_stars(spark):
    """A group over the block size is compared in pairs of blocks, a bucket over it as a star; nothing is lost."""
    import random

    from llm.op8_minhash import near_duplicates

    rnd = random.Random(6)
    base = c.prose(rnd, 120).split()
    docs = []
    for k in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = c.word(rnd)
        docs.append((k, " ".join(w)))
    docs += [(100 + k, c.prose(rnd, 80)) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, size=4, block=8).collect()}
    assert got == {i: root for i, (_, root) in groups(docs, 4).items()}


def test_op9_repeated_words(spark, corpus):
    got, first = run(spark, corpus, "op9_"), {}
    for i, t in ordered():
        w = c.WORD.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in c.documents():
        w = c.WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        r = got[i][0]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))


def test_op10_counts(spark, corpus):
    got = run(spark, corpus, "op10_")
    for i, t in c.documents():
        t = t or ""
        w = c.WORD.findall(t)
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        seen, twins = set(), 0
        for line in t.split("\n"):
            if c.WORD.search(line):
                twins += line in seen
                seen.add(line)
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twins, len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
        if not r.base_failed:
            assert r.kept == ("!!" not in t and i != 1005)


def test_op10_order_does_not_matter(spark, corpus):
    from llm.op10_rules import RULES, quality_rules

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    sets = [{(r.doc_id, r.kept) for r in quality_rules(docs, order).collect()} for order in (list(RULES), list(reversed(RULES)))]
    assert sets[0] == sets[1]


def test_null_ids(spark, tmp_path):
    """Rows without an id: every operator gives a row and does not fail."""
    docs = [(None, t) for _, t in c.documents()[:12]] + [(k, t) for k, t in c.documents()[:12]]
    path = c.write(spark, tmp_path, docs=docs)
    for name, f in QUERIES.items():
        if not name.startswith(("op3_", "op6_")):
            assert f(spark, path).count() == 24, name
        else:
            f(spark, path).count()
