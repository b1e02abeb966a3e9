"""Secret scans: patterns with positions, and weak candidates linked to their complementary parts.

All of it is DataFrame functions.  A pattern's places come from the lengths of
its matches and of the pieces between them.  Strong parts - assignments, access
identifiers, long hex - are reported as they stand.  Weak parts - runs of exactly
40 characters that may be a secret key, and endpoints of any length - are common in
harmless text, so they are reported only where parts that complement them stand in
the same scope: a secret key near an access identifier, an endpoint near an
identifier and a secret.  A scope reaches SCOPE characters to either side; parts are
joined as intervals, each in all cells of that width that it or its scope touches,
so a cell holds few parts however long a text.

Offsets are code points, ends exclusive.  Defined results: null and empty texts
have no spans, an empty table gives no rows; parts of equal start are listed in the
kinds' order; long texts are scanned whole, running sums and redaction going by
blocks of 256 parts; repeated rows get their result each; only doc_id and text are
read (and n_chars brought up to date by the redaction), so other columns may have
any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, fresh, load, written

SCOPE = 256

_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAME = "|".join(map(_EITHER, ("password", "passwd", "secret", "token"))) + "|" + _EITHER("api") + "_?" + _EITHER("key")

#: kind: (pattern, group whose length counts, least and greatest length); the order is that of equal starts.
BASE = {
    "assign": (rf"""({_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, None),
    # Runs of the whole class are matched or dropped as a whole, so the least length may stand in the pattern.
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16, None),
    "hex": (r"[0-9a-f]{32,}", 0, 32, None),
}
WEAK = {
    # A longer run is no key.
    "key": (r"[A-Za-z0-9/+]{40,}", 0, 40, 40),
    "endpoint": (r"https?://[A-Za-z0-9.:_/-]{4,}", 0, 0, None),
}
KINDS = [*BASE, *WEAK]
_SPANS = "array<struct<s:int,e:int>>"


def places(text: Column, pattern: str, group: int, least: int, most: int | None = None) -> Column:
    """Start and end of every match whose group has such a length, in order.

    Running sums are taken in blocks of 256 matches, so that a text full of
    matches costs little more than its length.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), counts, lambda a, c: F.struct(a["g"].alias("g"), a["m"].alias("m"), F.length(c).alias("c")))
    sizes = F.filter(sizes, lambda x: x["m"].isNotNull())

    def block(acc, part):
        inner = F.aggregate(
            part,
            F.struct(acc["at"].alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,c:int>>)").alias("out")),
            lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["m"]).alias("e"), x["c"].alias("c")))).alias("out")),
        )
        return F.struct(inner["at"].alias("at"), F.concat(acc["all"], F.array(inner["out"])).alias("all"))

    parts = F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(256)), lambda k: F.slice(sizes, k + 1, 256))
    all_of = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<s:int,e:int,c:int>>>)").alias("all")), block, lambda acc: F.flatten(acc["all"]))
    kept = F.transform(F.filter(all_of, lambda x: (x["c"] >= least) & (F.lit(True) if most is None else x["c"] <= most)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return F.when(text.rlike(pattern), kept).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def parts_table(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: rid (names the row), doc_id, text_hash, and an array of places for each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [places(text, *spec).alias(kind) for kind, spec in (BASE | WEAK).items()]
    return written(docs.select("doc_id", "text").select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), *columns), "parts")


def _exploded(parts: DataFrame, kind: str) -> DataFrame:
    return parts.select("rid", F.explode(kind).alias("x")).select("rid", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


def _cells(rows: DataFrame, scope: int, reach: int) -> DataFrame:
    """Each interval in every cell that it touches, with `reach` characters to either side."""
    return rows.withColumn("c", F.explode(F.sequence(F.floor((F.col("s") - reach) / scope), F.floor((F.col("e") + reach) / scope))))


def _near(weak: DataFrame, strong: DataFrame, scope: int) -> DataFrame:
    """The weak intervals within the scope of a strong one: an interval join on row and cell."""
    other = _cells(strong, scope, scope).select(F.col("rid").alias("r"), F.col("s").alias("bs"), F.col("e").alias("be"), F.col("c").alias("b"))
    close = (F.col("s") <= F.col("be") + scope) & (F.col("bs") <= F.col("e") + scope)
    return _cells(weak, scope, 0).join(other, (F.col("rid") == F.col("r")) & (F.col("c") == F.col("b")) & close, "left_semi").select("rid", "s", "e").distinct()


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rid, kind, s, e of the weak parts that have their complements in scope."""
    access = _exploded(parts, "access")
    keys = _near(_exploded(parts.where(F.size("access") > 0), "key"), access, scope)
    secrets = _exploded(parts, "assign").unionByName(_exploded(parts, "hex")).unionByName(keys)
    endpoints = _near(_near(_exploded(parts.where(F.size("access") > 0), "endpoint"), access, scope), secrets, scope)
    return keys.select("rid", F.lit("key").alias("kind"), "s", "e").unionByName(endpoints.select("rid", F.lit("endpoint").alias("kind"), "s", "e"))


def _joined(spans: Column) -> Column:
    order = F.array_sort(spans)
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash, an array of places for each base kind, links (weak parts with complements), base_spans and spans as text."""
    parts = parts_table(docs)
    more = linked(parts, scope).groupBy("rid").agg(F.collect_set(F.struct("s", F.when(F.col("kind") == "key", 3).otherwise(4).alias("k"), "e")).alias("links"))
    tagged = F.concat(*(F.expr(f"transform({kind}, x -> struct(x.s AS s, {k} AS k, x.e AS e))") for k, kind in enumerate(BASE)))
    out = parts.join(more, "rid", "left").withColumn("tagged", tagged)
    links = F.coalesce("links", F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)"))
    return out.select("doc_id", "text_hash", *BASE, links.alias("links"), _joined(F.col("tagged")).alias("base_spans"), _joined(F.concat("tagged", links)).alias("spans"))


def redacted(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """The documents with their columns; every reported span of a text is replaced by the mark.

    Spans are brought back to the texts by id and text hash, so rows that share an id do not mix.
    """
    every = F.concat(*(F.expr(f"transform({kind}, x -> struct(x.s AS s, x.e AS e))") for kind in BASE), F.expr("transform(links, x -> struct(x.s AS s, x.e AS e))"))
    found = secrets(docs, scope).select("doc_id", "text_hash", F.array_sort(every).alias("spans")).where(F.size("spans") > 0)
    found = found.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    names = {c: fresh(docs.columns, f"{c}_found") for c in ("doc_id", "text_hash", "spans")}
    found = written(found.select(*(F.col(c).alias(n) for c, n in names.items())), "spans")
    rows, parts = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(names["spans"])), F.lit(0))).first()
    if rows + parts <= SMALL:  # 16 MB and as many rows' overhead
        found = F.broadcast(found)
    here = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    both = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[names["doc_id"]]) & (here == found[names["text_hash"]]), "left")

    spans = F.col(names["spans"])

    def block(acc, part):
        size = F.greatest(F.array_max(F.transform(part, lambda x: x["e"])) - acc["at"], F.lit(0))
        here = F.substring(acc["rest"], F.lit(1), size)

        def cut(a, x):
            more = F.struct(x["e"].alias("to"), F.concat(a["out"], F.when(x["s"] >= a["to"], F.concat(F.substring(here, a["to"] - acc["at"] + 1, x["s"] - a["to"]), F.lit(mark))).otherwise("")).alias("out"))
            return F.when(x["e"] > a["to"], more).otherwise(a)

        done = F.aggregate(part, F.struct(acc["at"].alias("to"), F.lit("").alias("out")), cut)
        return F.struct((acc["at"] + size).alias("at"), F.substring(acc["rest"], size + 1, F.length(acc["rest"])).alias("rest"), F.concat(acc["all"], F.array(done["out"])).alias("all"))

    blocks = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(256)), lambda k: F.slice(spans, k + 1, 256))
    start = F.struct(F.lit(0).alias("at"), F.col("text").alias("rest"), F.array().cast("array<string>").alias("all"))
    done = F.aggregate(blocks, start, block)
    text = F.when(F.col(names["spans"]).isNull(), F.col("text")).otherwise(F.concat(F.array_join(done["all"], ""), done["rest"]))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(names["spans"]).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(load(spark, sf_dir, "documents"))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE]
    return out.select("doc_id", *counts, F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def _sql_places(kind: str, pattern: str, group: int, least: int, most: int | None) -> str:
    text = pattern.replace("'", "''")
    counts = f"regexp_extract_all(t, '{text}', {group})"
    return f"""
  "{kind}_0" AS (SELECT rid, regexp_extract_all(t, '{text}') AS m, {counts} AS c, string_split_regex(t, '{text}') AS g FROM texts WHERE regexp_matches(t, '{text}')),
  "{kind}_1" AS (SELECT rid, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(c) AS c, unnest(g[1:len(m)]) AS g FROM "{kind}_0"),
  "{kind}" AS (SELECT rid, e - len(m) AS s, e, len(c) AS c FROM (SELECT *, sum(len(g) + len(m)) OVER (PARTITION BY rid ORDER BY i) AS e FROM "{kind}_1") WHERE len(c) BETWEEN {least} AND {most or 1 << 60})"""


def _sql() -> str:
    near = "a.rid = b.rid AND a.s <= b.e + 256 AND b.s <= a.e + 256"
    base = " UNION ALL ".join(f"SELECT rid, s, {k} AS k, e FROM {kind}" for k, kind in enumerate(BASE))
    name = "CASE k " + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(KINDS)) + " END"
    text = f"string_agg({name} || ':' || s::BIGINT::VARCHAR || ':' || e::BIGINT::VARCHAR, ',' ORDER BY s, k)"
    every = ",".join(_sql_places(kind, *spec) for kind, spec in (BASE | WEAK).items())
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),{every},
  keys AS (SELECT DISTINCT a.rid, a.s, a.e FROM "key" a JOIN access b ON {near}),
  parts AS (SELECT rid, s, e FROM assign UNION ALL SELECT rid, s, e FROM hex UNION ALL SELECT rid, s, e FROM keys),
  ends AS (SELECT DISTINCT a.rid, a.s, a.e FROM endpoint a JOIN access b ON {near} WHERE EXISTS (SELECT 1 FROM parts b WHERE {near})),
  base AS ({base}),
  spans AS (SELECT * FROM base UNION ALL SELECT rid, s, 3, e FROM keys UNION ALL SELECT rid, s, 4, e FROM ends),
  counted AS (SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, {text} AS x FROM base GROUP BY rid),
  listed AS (SELECT rid, {text} AS x FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(counted.x, '')) AS base_sha256, coalesce(listed.x, '') AS spans
FROM texts LEFT JOIN counted USING (rid) LEFT JOIN listed USING (rid)"""


ORACLE = _sql()
