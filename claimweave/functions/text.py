"""Texts: white space, quotes, tables, chunks and batches; all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import strip


def normal_space(text: Column) -> Column:
    """One space for any white space, ends trimmed, lower case.  (?U): no-break spaces count too."""
    return F.lower(F.btrim(F.regexp_replace(text, r"(?U)\s+", " ")))


def simple_lower(text: Column) -> Column:
    """Lower case letter by letter: one letter for one, whatever stands around it, as SQL engines do it."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def simple_upper(text: Column) -> Column:
    """Upper case letter by letter; a letter whose capital would be more than one, as that of ß, stays."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def plain_space(text: Column) -> Column:
    """As `normal_space`, but within a text only blanks, tabs and line ends are white space, and case goes letter by letter."""
    spaces = F.regexp_replace(text, r"[\t\n\f\r ]+", " ")
    return simple_lower(F.regexp_replace(spaces, r"^\p{Zs}+|\p{Zs}+$", ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def layout_space(text: Column) -> Column:
    """Runs of three or more spaces become two; blank lines go."""
    return F.array_join(F.filter(F.split(F.regexp_replace(text, " {3,}", "  "), "\n"), lambda line: F.btrim(line) != ""), "\n")


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n\s*\n")


def clean_cell(cell: Column) -> Column:
    return F.replace(strip(F.coalesce(cell, F.lit(""))), F.lit("\n"), F.lit(" "))


def tokens(text: Column) -> Column:
    """An estimate: a quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("int")


def markdown(table: Column, page: Column) -> Column:
    """A table as markdown, rows cut or filled to the header's width; empty without headers."""
    wide = F.size(table["headers"])
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fit = lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), wide)), F.lit(1), wide)
    body = F.transform(table["rows"], lambda row: line(fit(row)))
    rule = line(F.array_repeat(F.lit("---"), wide))
    caption = F.array(F.concat(F.lit("Table on page "), page.cast("string")))
    return F.when(wide > 0, F.array_join(F.concat(caption, F.array(line(table["headers"])), F.array(rule), body), "\n")).otherwise("")


def in_order_share(needle: Column, haystack: Column) -> Column:
    """Share of the needle's words that a greedy walk through the haystack's words finds, each behind the one before.

    A word that isn't found uses the haystack up, so nothing after it counts.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("hits"))

    def step(acc, word):
        here = F.array_position(F.slice(haystack, acc["at"] + 1, F.greatest(F.size(haystack) - acc["at"], F.lit(0))), word).cast("int")
        found = F.struct((acc["at"] + here).alias("at"), (acc["hits"] + 1).alias("hits"))
        return F.when(here > 0, found).otherwise(F.struct(F.size(haystack).alias("at"), acc["hits"].alias("hits")))

    return F.when(F.size(needle) > 0, F.aggregate(needle, start, step, lambda acc: acc["hits"] / F.size(needle))).otherwise(0.0)


def stands_exactly(quote: Column, page: Column) -> Column:
    return page.contains(strip(quote))


def stands_flat(flat_quote: Column, flat_page: Column) -> Column:
    """Whether a quote stands on a page, both with normal space."""
    return flat_page.contains(flat_quote)


def stands_fuzzily(needle: Column, hay: Column, fuzzy: float) -> Column:
    """Whether enough of a quote's words stand on a page in order.  Without enough common words the walk isn't made."""
    shared = F.size(F.array_intersect(needle, hay)) + F.size(needle) - F.size(F.array_distinct(needle))
    return (shared >= F.size(needle) * fuzzy) & (in_order_share(needle, hay) >= fuzzy)


def quote_tier(quote: Column, page: Column, fuzzy: float, flat_quote: Column | None = None, flat_page: Column | None = None) -> Column:
    """exact, normalized, fuzzy, or null: how a quote stands on a page; flat texts that are at hand save making them."""
    flat_quote = normal_space(quote) if flat_quote is None else flat_quote
    flat_page = normal_space(page) if flat_page is None else flat_page
    return (
        F.when(F.btrim(quote) == "", None)
        .when(stands_exactly(quote, page), "exact")
        .when(stands_flat(flat_quote, flat_page), "normalized")
        .when(stands_fuzzily(words(flat_quote), words(flat_page), fuzzy), "fuzzy")
    )


def packed_bins(sizes: Column, most: Column | int) -> Column:
    """For each size of an ordered array its bin's number, when a bin is closed before it would exceed `most`."""
    limit = most if isinstance(most, Column) else F.lit(most)
    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("bin"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc, size):
        full = (acc["held"] > 0) & (acc["sum"] + size > limit)
        number = acc["bin"] + full.cast("int")
        return F.struct(
            F.when(full, 1).otherwise(acc["held"] + 1).alias("held"),
            number.alias("bin"),
            F.when(full, size).otherwise(acc["sum"] + size).cast("int").alias("sum"),
            F.concat(acc["out"], F.array(number)).alias("out"),
        )

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def page_bins(pages: Column, tokens_most: int, pages_most: int) -> Column:
    """Bins of an ordered array of struct(tokens, tabled, next_tabled).

    A page over the budget opens a new bin, unless it and the next page have
    tables, the bin has at most one page too many, and it stays under 1.3 budgets.
    """
    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("bin"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc, page):
        total = acc["sum"] + page["tokens"]
        over = (acc["held"] > 0) & ((total > tokens_most) | (acc["held"] >= pages_most))
        goes_on = page["tabled"] & page["next_tabled"] & (acc["held"] < pages_most + 2) & (total < tokens_most * 1.3)
        new = over & ~goes_on
        number = acc["bin"] + new.cast("int")
        return F.struct(
            F.when(new, 1).otherwise(acc["held"] + 1).alias("held"),
            number.alias("bin"),
            F.when(new, page["tokens"]).otherwise(total).cast("int").alias("sum"),
            F.concat(acc["out"], F.array(number)).alias("out"),
        )

    return F.aggregate(pages, start, step, lambda acc: acc["out"])


def file_id(content: Column) -> Column:
    """Twelve hex digits of the hash of a file's size and the hash of its first 8 KiB."""
    return F.substring(F.sha2(F.concat_ws(":", F.length(content).cast("string"), F.md5(F.substring(content, 1, 8192))), 256), 1, 12)


def highlight(text: Column, part: Column) -> Column:
    """struct(before, match, after) of the first hit, whatever the case."""
    at = F.instr(F.lower(text), F.lower(part))
    n = F.length(part)
    hit = (at > 0) & (n > 0)
    return F.struct(
        F.when(hit, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("before"),
        F.when(hit, F.substring(text, at, n)).otherwise("").alias("match"),
        F.when(hit, F.substring(text, at + n, F.length(text))).otherwise("").alias("after"),
    )
