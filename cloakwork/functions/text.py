"""Text expressions: white space, windows, and matches with their places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The pieces between runs of white space; none for a blank text."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: a column is worked out anew wherever it stands in f, and in a
    lambda for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def found_texts(text: Column, regex: str) -> Column:
    """The texts of all matches, in order, without their places."""
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def matches(text: Column, regex: str | Column, found: Column | None = None) -> Column:
    """array<struct<start, end, span>> of all matches, in order; 0-based code points, end exclusive.

    The expression must not match the empty string. Null texts have a null array. found: the column of
    `found_texts` from an earlier projection, so that texts without a match are scanned once only.
    """
    found = found_texts(text, regex) if found is None else found  # a column of expressions needs found
    gaps = F.split(text, regex, -1)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,span:string>>)")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        hit = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("span"))
        return F.struct(end.alias("at"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("hit")))
    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("hits")), step, lambda acc: acc["hits"])
    return F.when(F.size(found) > 0, folded).when(text.isNotNull(), empty)


#: Put around matches to split a text at them; for private use.
MARK = "\ue000"


def pieces(text: Column, regex: str) -> Column:
    """The text cut at its matches: what stands before the first, the first, what stands before the next,
    and so on to what stands behind the last. One element without a match; null for null texts.

    The text is scanned once; only one that holds the mark itself is scanned twice.
    """
    once = F.split(F.regexp_replace(text, regex, f"{MARK}$0{MARK}"), MARK, -1)
    found = found_texts(text, regex)
    twice = F.flatten(F.zip_with(F.split(text, regex, -1), F.concat(found, F.array(F.lit(""))), lambda g, m: F.array(g, m)))
    return F.when(F.contains(text, F.lit(MARK)), F.slice(twice, F.lit(1), F.size(twice) - 1)).otherwise(once)


def placed(cut: Column) -> Column:
    """array<struct<start, end, span>> as of `matches`, of what `pieces` gave."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,span:string>>)")
    sized = F.transform(cut, lambda p, k: F.struct(F.length(p).alias("n"), p.alias("span"), (k % 2 == 1).alias("hit")))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + p["n"]
        hit = F.struct(acc["at"].alias("start"), end.alias("end"), p["span"].alias("span"))
        return F.struct(end.alias("at"), F.when(p["hit"], F.concat(acc["hits"], F.array(hit))).otherwise(acc["hits"]).alias("hits"))

    return F.aggregate(sized, F.struct(F.lit(0).alias("at"), empty.alias("hits")), step, lambda acc: acc["hits"])


def window(text: Column, start: Column, end: Column, around: int) -> Column:
    """The text from `around` characters before start to as many after end."""
    low = F.greatest(start - around, F.lit(0))
    return F.substring(text, low + 1, end + around - low)


#: Characters before a place among which the words before it are looked for, and those that are read first.
BEFORE, FIRST = 256, 64


def words_before(text: Column, start: Column, count: int) -> Column:
    """The last words before a place, in lower case, joined by blanks; of the BEFORE characters before it,
    cut at white space, so that a long text isn't split anew for every place in it."""

    def near(size: int) -> Column:
        low = F.greatest(start - size, F.lit(0))
        return F.substring(text, low + 1, start - low)

    def last(some: Column) -> Column:
        """Read backwards, so that no more is read than the words asked for."""
        return F.reverse(F.regexp_extract(F.reverse(some), rf"(?U)^\s*+(?:\S++\s++){{0,{max(count - 1, 0)}}}+\S*+", 0))

    def whole() -> Column:
        """Where the few characters hold too few words, or end within one."""
        before = words(F.when(start > BEFORE, F.regexp_replace(near(BEFORE), r"(?U)^\S*\s", "")).otherwise(near(BEFORE)))
        return F.array_join(F.slice(before, F.greatest(F.size(before) - count, F.lit(0)) + 1, F.lit(count)), " ")

    few = let(last(near(FIRST)), lambda w: F.when((start > FIRST) & (F.length(w) >= FIRST), whole()).otherwise(F.btrim(F.regexp_replace(w, r"(?U)\s+", " "))))
    return F.lower(few) if count > 0 else F.left(text, F.lit(0))
