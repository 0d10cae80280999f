"""Pattern detection: one pass over the text for all recognizers, then rescoring, gates and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.boxes import specificity
from cloakwork.functions.checks import CHECKS
from cloakwork.functions.patterns import CONTEXT, Pattern, Registry, ahead, word_only
from cloakwork.functions.text import found_texts, let, matches, pieces, placed, words_before

#: What a context word adds to a score, and the words before a hit among which it is looked for.
BOOST, WORDS = 0.35, 5


def score_of(pattern: Pattern) -> float:
    """The score of a pattern's hit that passed the pattern's check, if it has one."""
    sure = CHECKS[pattern.check][1] if pattern.check else None
    return pattern.score if sure is None else sure


def hits(text: Column, pattern: Pattern, texts: Column | None = None) -> Column:
    """array<struct<start, end, span, entity_type, pattern, score>> of a pattern's matches that hold.
    texts: what `found_texts` gave for the pattern, where an earlier projection has it."""
    found = matches(text, pattern.regex, texts)
    if pattern.check:
        found = F.filter(found, lambda h: CHECKS[pattern.check][0](h["span"]))
    return F.transform(
        found,
        lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["span"].alias("span"), F.lit(pattern.entity).alias("entity_type"), F.lit(pattern.name).alias("pattern"), F.lit(float(score_of(pattern))).alias("score")),
    )


def _scans(patterns: tuple[Pattern, ...]) -> list[tuple[str, list[int]]]:
    """Expressions to scan for, each with the patterns whose matches it finds. Patterns of whole words share
    one scan: their matches are words, so none of them can begin or end inside another."""
    words = [k for k, p in enumerate(patterns) if word_only(p.regex)]
    scans = [(ahead(p.regex) + p.regex, [k]) for k, p in enumerate(patterns) if k not in words or len(words) == 1]
    if len(words) > 1:
        regexes = list(dict.fromkeys(patterns[k].regex for k in words))
        scans.append((rf"{ahead(*regexes)}\b(?:{'|'.join(map(word_only, regexes))})\b", words))
    return scans


def detect(df: DataFrame, text_col: str = "text", registry: Registry | None = None, keep: tuple[str, ...] = ("doc_id",), places: bool = True) -> DataFrame:
    """A row per match of every pattern: the kept columns, start, end, span, entity_type, pattern, score.
    Without places, start and end are null and aren't worked out: enough for counts and for evaluation.

    Texts are read once, whatever the number of patterns; null texts have no rows. The expressions are
    row-local, so the same frame may be a stream.
    """
    patterns = (registry or Registry()).patterns
    columns = list(dict.fromkeys([*keep, text_col]))
    scans = _scans(patterns)
    cut = [F.struct(F.lit(k).alias("scan"), (pieces if places else found_texts)(F.col(text_col), regex).alias("texts")) for k, (regex, _) in enumerate(scans)]
    some = df.select(*columns, F.inline(F.filter(F.array(*cut), lambda t: F.size(t["texts"]) > int(places))))
    # a row per text and scan with matches: places and checks are worked out for these only
    none = F.lit(None).cast("int")
    spans = placed(F.col("texts")) if places else F.transform("texts", lambda t: F.struct(none.alias("start"), none.alias("end"), t.alias("span")))
    found = some.select(*columns, "scan", F.inline(spans))
    about = [F.struct(F.lit(k).alias("_which"), F.lit(p.entity).alias("entity_type"), F.lit(p.name).alias("pattern"), F.lit(float(score_of(p))).alias("score")) for k, p in enumerate(patterns)]
    by_scan = F.get(F.array(*[F.array(about[own[0]]) for _, own in scans]), F.col("scan"))
    for k, (_, own) in enumerate(scans):
        if len(own) > 1:
            fits = F.array(*[F.when(F.col("span").rlike(rf"\A{word_only(patterns[i].regex)}\z"), about[i]) for i in own])
            by_scan = F.when(F.col("scan") == k, F.filter(fits, lambda h: h.isNotNull())).otherwise(by_scan)
    hits_ = found.select(*columns, "start", "end", "span", F.inline(by_scan))
    holds = F.lit(True)
    for name, (check, _) in CHECKS.items():
        own = [k for k, p in enumerate(patterns) if p.check == name]
        if own:
            holds = F.when(F.col("_which").isin(*own), check(F.col("span"))).otherwise(holds)
    return hits_.filter(holds).select(*keep, "start", "end", "span", "entity_type", "pattern", "score")


def _scanned(df: DataFrame, text_col: str, registry: Registry) -> tuple[DataFrame, Column]:
    """df with the texts of all patterns' matches, and the array of all hits over it. Two projections:
    the second finds places only where the first found something."""
    names = [f"_found_{k}" for k in range(len(registry.patterns))]
    found = df.withColumns({name: found_texts(F.col(text_col), p.regex) for name, p in zip(names, registry.patterns)})
    return found, F.flatten(F.array(*[hits(F.col(text_col), p, F.col(name)) for name, p in zip(names, registry.patterns)]))


def rescored(spans: DataFrame, text: Column, boost: float = BOOST, words: int = WORDS) -> DataFrame:
    """Scores raised by boost, to 1 at most, where a context word of the type stands before the hit."""
    before = words_before(text, F.col("start"), words)
    table = F.create_map(*[x for k, v in CONTEXT.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    near = let(before, lambda b: F.exists(table[F.col("entity_type")], lambda w: F.contains(b, w)))
    return spans.withColumn("score", F.when(F.coalesce(near, F.lit(False)), F.least(F.lit(1.0), F.col("score") + boost)).otherwise(F.col("score")))


def gated(spans: DataFrame, least: float | None = 0.60) -> DataFrame:
    """Hits scoring at least `least`; None lets all pass."""
    return spans if least is None else spans.filter(F.col("score") >= least)


def outermost(spans: DataFrame, *keys: str) -> DataFrame:
    """Without hits of a type that lie inside another hit of the type on the same text; of equal hits the
    surest stays, then the first pattern by name."""
    # fields in order: start rising, then the longer, the surer, the first by name
    order = F.struct("start", (-F.col("end")).alias("back"), (-F.col("score")).alias("minus"), "pattern", "end", "span", "score")
    groups = spans.groupBy(*keys, "entity_type").agg(F.array_sort(F.collect_list(order)).alias("all"))
    empty = F.expr("cast(array() as array<struct<start:int,back:int,minus:double,pattern:string,end:int,span:string,score:double>>)")
    kept = F.aggregate("all", F.struct(F.lit(-1).alias("far"), empty.alias("out")), lambda acc, h: F.when(h["end"] <= acc["far"], acc).otherwise(F.struct(h["end"].alias("far"), F.concat(acc["out"], F.array(h)).alias("out"))), lambda acc: acc["out"])
    return groups.select(*keys, "entity_type", F.inline(kept)).select(*keys, "start", "end", "span", "entity_type", "pattern", "score")


def resolved(spans: Column) -> Column:
    """An array of hits without overlaps: the most specific type stays, then the surest, the longest, the
    first. Sorted by start."""
    ranked = F.array_sort(
        F.transform(spans, lambda h: F.struct((-specificity(h["entity_type"])).alias("a"), (-h["score"]).alias("b"), (h["start"] - h["end"]).alias("c"), h["start"].alias("start"), h["entity_type"].alias("entity_type"), h["end"].alias("end")))
    )
    kept = F.aggregate(
        ranked,
        F.slice(ranked, 1, 0),
        lambda acc, h: F.when(F.exists(acc, lambda k: (k["start"] < h["end"]) & (h["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(h))),
    )
    return F.array_sort(F.transform(kept, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["entity_type"].alias("entity_type"))))


def mask(text: Column, spans: Column, style: str = "type") -> Column:
    """The text with its hits replaced: by their type in brackets, by blocks of their length, or by
    nothing ("type", "block", "drop"). Overlaps are resolved first; the rest of the text stays."""
    if style not in ("type", "block", "drop"):
        raise ValueError(f"no style {style!r}")

    def instead(h: Column) -> Column:
        if style == "type":
            return F.concat(F.lit("["), h["entity_type"], F.lit("]"))
        return F.repeat(F.lit("█"), h["end"] - h["start"]) if style == "block" else F.lit("")

    return F.aggregate(
        resolved(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, h: F.struct(h["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, h["start"] - acc["at"]), instead(h)).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )


def masked(df: DataFrame, text_col: str = "text", registry: Registry | None = None, least: float | None = 0.60, style: str = "type") -> DataFrame:
    """df with its text masked, without a shuffle; null texts stay null."""
    found, every = _scanned(df, text_col, registry or Registry())
    if least is not None:
        every = F.filter(every, lambda h: h["score"] >= least)
    found = found.withColumn("_hits", every)
    text = F.when(F.size("_hits") > 0, mask(F.col(text_col), F.col("_hits"), style)).otherwise(F.col(text_col))
    return found.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns])


def deduplicated(spans: DataFrame, *keys: str) -> DataFrame:
    """One hit per place and type: the surest, then the first pattern by name."""
    order = Window.partitionBy(*keys, "start", "end", "entity_type").orderBy(F.desc("score"), "pattern")
    return spans.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
