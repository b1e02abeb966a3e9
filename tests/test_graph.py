from __future__ import annotations

from facts import facts

from claimweave import Config
from claimweave.plans import extraction, graph
from claimweave.sources import backends, files
from claimweave.sources.store import Store
from claimweave.streaming import append


def test_extraction_to_facts(spark):
    raw = spark.createDataFrame(
        [("d", 0, "Acme Ltd", "net_profit_after_tax", "₹2.5 crore", None, "INR", 0, "monetary", "FY25", None, None, "profit was  ₹2.5 CRORE", 1), ("d", 1, "Acme", "revenue", "10", 10.0, None, 6, None, None, None, "adjusted", "made up entirely", 0)],
        "doc_id string, fact_seq int, subject string, predicate string, value string, numeric_value double, base_unit string, scale int, dimension string, temporal string, scope string, conditions string, evidence_quote string, page_number int",
    )
    pages = spark.createDataFrame([("d", 0, "first page"), ("d", 1, "The profit was ₹2.5 crore.")], "doc_id string, page_number int, raw_text string")
    a, b = extraction.normalised(raw, pages).orderBy("fact_id").collect()
    assert (a.predicate, a.conditions, a.canonical_value, a.canonical_unit, a.match_type, a.page, a.confidence) == ("net_profit", "after-tax", 2.5e7, "INR", "normalized", 1, 0.95)
    assert (b.canonical_value, b.unit, b.match_type, b.confidence, b.conditions) == (1e7, "million", "unverified", 0.1, "adjusted")


def test_graph_store_and_append(spark, tmp_path):
    old = [{"doc_id": "a", "subject": "Acme", "canonical_value": 5}, {"doc_id": "b", "subject": "Acme", "canonical_value": 5}, {"doc_id": "a", "subject": "Zeta", "canonical_value": 7}, {"doc_id": "a", "subject": "Orca", "canonical_value": 1}]
    built = graph.build_claim_graph(facts(spark, old))
    row = built.clusters.first()
    assert (row.subject, row.size, row.doc_count, row.case_type) == ("Acme", 2, 2, "corroborated")
    assert {r.case_type: r.n for r in built.summary().collect()} == {"corroborated": 1}
    assert graph.showcase(built)["corroborated"].first().cluster_id == row.cluster_id
    assert built.of("reconciled").count() == 0 and built.of(doc_id="b").count() == 1

    store = Store(spark, str(tmp_path / "store"))
    store.save_graph(built)
    store.upsert("facts", facts(spark, old))
    again = Store(spark, str(tmp_path / "store"))
    assert again.graph()["clusters"].count() == 1 and again.facts().count() == 4
    assert again.delete_facts("b") and again.facts().count() == 3

    # Zeta gets a second value, Iris is new; the Acme cluster stays as it is.
    new = [{"doc_id": "c", "subject": "Zeta", "canonical_value": 9}, {"doc_id": "c", "subject": "Iris", "canonical_value": 2}]
    out = append.append_document(built, facts(spark, new))
    assert tuple(out.stats.first()) == (2, 0, 1, 1, 1)
    assert {r.subject: r.case_type for r in out.graph.clusters.collect()} == {"Acme": "corroborated", "Zeta": "contradicted"}
    assert sorted(r.subject for r in out.graph.singletons.collect()) == ["Iris", "Orca"]


def test_append_misspelled_subject(spark):
    built = graph.build_claim_graph(facts(spark, [{"doc_id": "a", "subject": "Delhivery"}, {"doc_id": "b", "subject": "Delhivery"}, {"doc_id": "a", "subject": "Orca"}]))
    out = append.append_document(built, facts(spark, [{"doc_id": "c", "subject": "Delhvery"}, {"doc_id": "c", "subject": "Iris"}]))
    assert tuple(out.stats.first()) == (2, 1, 0, 1, 0)
    assert sorted(r.subject for r in out.graph.members.collect()) == ["Delhivery", "Delhivery", "Delhvery"]


def test_misspelled_is_lossless(spark):
    from difflib import SequenceMatcher
    from random import Random

    from claimweave.operators.matching import misspelled
    from claimweave.runtime import ship

    ship(spark)

    rnd = Random(3)
    words = ["", "brand#11", "brand#12", "é😀é😀é", "é😀é😀"] + ["".join(rnd.choice("abc1") for _ in range(rnd.randint(1, 14))) for _ in range(120)]
    new, known = words[::2] + ["brand#12"], words[1::2] + ["brand#11"]
    want = {(a, b) for a in new for b in known if a != b and SequenceMatcher(None, a, b).ratio() > 0.80}
    got = misspelled(spark.createDataFrame([(w,) for w in new], "term string"), spark.createDataFrame([(w,) for w in known], "term string"))
    assert want and {tuple(r) for r in got.collect()} == want


def test_guard(spark):
    rows = facts(spark, [{}, {}])
    assert graph.guarded(rows, Config(max_facts=2)).count() == 2
    try:
        graph.guarded(rows, Config(max_facts=1))
    except ValueError:
        return
    raise AssertionError("too many facts must be refused")


def test_backends(spark):
    now = [0.0]
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = backends.TokenBucket(1.0, 2, lambda: now[0], sleep)
    for _ in range(4):
        bucket.take()
    assert len(slept) == 2

    def broken(prompt):
        raise RuntimeError("503 overloaded")

    ask = backends.Cascade({"first": broken, "second": lambda p: p.upper()}, None, lambda: now[0])
    assert ask("x") == ("X", "second", 2) and ask("x") == ("X", "second", 1)
    assert 0 < ask.resting["first"] - now[0] <= 60
    prompts = spark.createDataFrame([("d", 0, "x")], "doc_id string, batch int, prompt string")
    got = backends.extract(prompts, lambda: backends.Cascade({"m": lambda p: '{"facts": [{"subject": "s", "predicate": "p", "value": "1"}]}'}))
    assert files.read_extraction(got).select("subject", "value").first() == ("s", "1")
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    cache = spark.createDataFrame([("a", [1.0])], "term string, vector array<float>")
    assert {r.term: r.vector for r in backends.embed(terms, cache, lambda ts: [[2.0] for _ in ts]).collect()} == {"a": [1.0], "b": [2.0]}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("first paragraph\n\nsecond one here\fpage two")
    pages = files.read_pages(spark, str(tmp_path / "in")).orderBy("page_number").collect()
    assert [p.page_number for p in pages] == [0, 1] and pages[0].blocks == ["first paragraph", "second one here"]
    html = spark.createDataFrame([("d", "u", bytearray(b"<p>Hello there</p><table><tr><th>a</th></tr><tr><td>1</td></tr></table>"))], "doc_id string, path string, content binary")
    page = files.parse_pages(html, files.html_text).first()
    assert page.blocks == ["Hello there"] and page.tables[0].headers == ["a"] and page.tables[0].rows == [["1"]]
    rows = facts(spark, [{"value": 'say "5"'}, {"verified": False, "subject": "Zeta"}])
    assert files.ledger(rows, match_type="unverified").first().subject == "Zeta" and files.ledger(rows, search="SAY").count() == 1
    files.write_ledger(rows, str(tmp_path / "csv"))
    text = "".join(f.read_text() for f in (tmp_path / "csv").glob("part-*"))
    assert '"say ""5"""' in text
    (tmp_path / "cache.json").write_text('{"key": "d:x", "facts": [{"subject": "s", "predicate": "p", "value": "v"}, {"subject": null}]}\nnot json\n')
    assert files.read_fact_cache(spark, str(tmp_path / "cache.json")).select("doc_id", "subject").collect() == [("d", "s")]


def test_stream_of_documents(spark, tmp_path):
    landing = str(tmp_path / "landing")
    facts(spark, [{}, {"doc_id": "b"}]).write.parquet(landing)
    seen = []
    stream = append.watch(spark, landing, facts(spark, [{}]).schema.simpleString()[7:-1].replace(":", " "), lambda rows, n: seen.append(rows.count()), str(tmp_path / "mark"))
    stream.awaitTermination(120)
    assert sum(seen) == 2
