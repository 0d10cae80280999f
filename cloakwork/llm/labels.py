"""Problem 3: free-entered values mapped to the closest entry of a reference list."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.session import one_of_each, stored

#: Least Jaccard similarity of a match.
LEAST = 0.3
#: Characters of a q-gram.
Q = 2

# Abbreviations that people type on forms.
ABBREVIATIONS = {
    "acct": "account", "addr": "address", "adr": "address", "auth": "authorization", "amt": "amount", "bal": "balance",
    "ben": "beneficiary", "bldg": "building", "cert": "certificate", "clm": "claim", "co": "company",
    "comp": "company", "cond": "condition", "cov": "coverage", "desc": "description", "diag": "diagnosis",
    "dl": "driver license", "dob": "date of birth", "dol": "date of loss", "dos": "date of service",
    "dt": "date", "dx": "diagnosis", "eff": "effective", "emer": "emergency", "emerg": "emergency", "emp": "employee", "est": "estimated",
    "exp": "expiration", "grp": "group", "hosp": "hospital", "id": "identifier", "ident": "identifier",
    "ins": "insurance", "insd": "insured", "inv": "invoice", "lic": "license", "loc": "location", "mbr": "member",
    "mem": "member", "mob": "mobile", "nbr": "number", "nm": "name", "no": "number", "nr": "number",
    "num": "number", "pat": "patient", "ph": "phone", "phys": "physician", "pol": "policy",
    "prem": "premium", "proc": "procedure", "prop": "property", "prov": "provider", "pt": "patient",
    "ref": "referring", "rel": "relationship", "repl": "replacement", "rpt": "report", "sig": "signature",
    "soc": "social", "sec": "security", "ssn": "social security number", "st": "street", "svc": "service",
    "tel": "phone", "trmt": "treatment", "tx": "treatment", "veh": "vehicle", "yr": "year",
}
# Characters that scanning confuses with letters.
CONFUSED = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "@": "a", "$": "s", "|": "l"})

_notes = re.compile(r"\(\s*required\s*\)|/\s*other\s*$|\bas shown\s*$|\.\.\.|[*:]+\s*$", re.I)
_number = re.compile(r"^\s*(?:\(?[a-z]\)|\d{1,3}[.)])\s+", re.I)
_words = re.compile(r"[^\W_]+|#")
_small = {"of", "the", "to", "your"}


def readings(text: str) -> list[list[str]]:
    """The words of a typed label, read in the ways that it can be read: as typed, and with
    abbreviations written out. Notes, numbering and possessives fall away."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).replace("’", "'").casefold()
    while (short := _notes.sub(" ", text).strip()) != text:
        text = short
    text = _number.sub("", text)
    text = re.sub(r"'s\b", "", text).replace("'", "")
    if not re.fullmatch(r"[\W\d_]*", text):
        text = re.sub(r"[0-9@$|]+", lambda m: m.group().translate(CONFUSED), text)
    words = _words.findall(text)
    if words and words[0] == "your" and len(words) > 1:
        words = words[1:]
    plain = [w for w in words if w != "#"]
    full = [x for w in words for x in ("number" if w == "#" else ABBREVIATIONS.get(w, w)).split()]
    out = [plain] if plain else []
    if full != plain and full:
        out.append(full)
    return out


def folded(text: str) -> str:
    """Letters that scanning takes for each other made the same."""
    return text.replace("rn", "m").replace("c", "e").replace("l", "i")


def grams(words: list[str]) -> list[str]:
    """Tokens of the words: the first and last letter of each, which don't depend on word order, and
    the q-grams of the text without spaces. A token that comes again counts as another one."""
    words = [folded(w) for w in words if w not in _small] or [folded(w) for w in words]
    tokens = [f"^{w[0]}" for w in words] + [f"{w[-1]}$" for w in words]
    tokens += ["".join(words)[k : k + Q] for k in range(max(1, len("".join(words)) - Q + 1))]
    seen: dict[str, int] = {}
    out = []
    for t in tokens:
        seen[t] = seen.get(t, 0) + 1
        out.append(t if seen[t] == 1 else f"{t}~{seen[t]}")
    return out


def _tokens(values: DataFrame) -> DataFrame:
    """value to rows (value, reading, words, tokens); values without letters have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, k, " ".join(r), grams(r)) for v in pdf["value"] for k, r in enumerate(readings(v))]
            yield pd.DataFrame(rows, columns=["value", "reading", "words", "tokens"])

    return values.mapInPandas(run, "value string, reading int, words string, tokens array<string>")


def _prefixes(sets: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    """The rare ends of token sets: (key, token, at, size), tokens ordered by global rarity.

    Two sets of sizes m, n with Jaccard t or more share a token among the first m - ceil(t m) + 1 of one
    and the first n - ceil(t n) + 1 of the other.
    """
    ordered = (
        sets.select(F.col("key").alias(name), F.explode("tokens").alias("token"))
        .join(ranks, "token")
        .groupBy(name)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("t"))
        .withColumn("size", F.size("t"))
    )
    prefix = F.slice("t", 1, (F.col("size") - F.ceil(F.col("size") * LEAST) + 1).cast("int"))
    return ordered.select(name, "size", F.posexplode(prefix).alias("at", "x")).select(name, F.col("size").alias(f"{name}_size"), F.col("at").alias(f"{name}_at"), F.col("x.token").alias("token"))


def similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l, r, jaccard) of token sets with Jaccard LEAST or more, by a prefix-filter join.

    left, right: (key, tokens); keys are unique on each side. Length and position filters thin the
    candidates, exact Jaccard verifies them.
    """
    both = left.select("tokens").unionByName(right.select("tokens")).select(F.explode("tokens").alias("token"))
    ranks = both.groupBy("token").count().select("token", F.struct("count", "token").alias("rank"))
    ranks = stored(ranks)
    a, b = _prefixes(left, ranks, "l"), _prefixes(right, ranks, "r")
    least = F.ceil((F.col("l_size") + F.col("r_size")) * (LEAST / (1 + LEAST)))
    left_over = F.least(F.col("l_size") - F.col("l_at"), F.col("r_size") - F.col("r_at"))
    pairs = (
        a.join(b, "token")
        .filter((F.least("l_size", "r_size") >= F.ceil(F.greatest("l_size", "r_size") * LEAST)) & (left_over + F.least("l_at", "r_at") >= least))
        .select("l", "r")
        .distinct()
    )
    full = pairs.join(left.select(F.col("key").alias("l"), F.col("tokens").alias("x")), "l").join(right.select(F.col("key").alias("r"), F.col("tokens").alias("y")), "r")
    same = F.size(F.array_intersect("x", "y"))
    return full.withColumn("jaccard", same / (F.size("x") + F.size("y") - same)).filter(F.col("jaccard") >= LEAST).select("l", "r", "jaccard")


def best_entries(values: DataFrame, entries: DataFrame) -> DataFrame:
    """value, entry, score: the entry of the list that each distinct value means, or null for none.

    values(value); entries(entry, label), few or many. The prefix-filter join of q-gram sets gives the
    entries with Jaccard LEAST or more over the readings of a value; the most similar wins, of equally
    similar ones the one with fewer edits, then the smaller. score is the similarity.
    """
    typed = stored(_tokens(values).withColumn("key", F.concat_ws("\u0001", "value", "reading")))
    known = stored(_tokens(entries.select(F.col("label").alias("value"))).filter("reading = 0").withColumnRenamed("value", "key"))
    candidates = similar(typed.select("key", "tokens"), known.select("key", "tokens"))
    scored = (
        candidates.join(typed.select(F.col("key").alias("l"), "value", "words"), "l")
        .join(known.select(F.col("key").alias("r"), F.col("words").alias("target")), "r")
        .join(entries.withColumnRenamed("label", "r"), "r")
    )
    order = F.struct("jaccard", (-F.levenshtein("words", "target")).alias("near"), (-F.col("entry")).alias("minus"))
    best = scored.groupBy("value").agg(F.max(order).alias("b"))
    return values.join(best.select("value", (-F.col("b.minus")).alias("entry"), F.col("b.jaccard").alias("score")), "value", "left")


def mapped(rows: DataFrame, canonical: DataFrame, id_col: str, value_col: str, entry_col: str, label_col: str) -> DataFrame:
    """id, entry, score for each row whose value is neither null nor blank nor an entry as it stands.

    entry is 0 where no entry is meant. Each id counts once; null ids are left out. Each distinct value
    is judged once, so repeated values cost nothing. Null, blank and repeated labels of the list don't
    count (of repeated ones the smallest entry holds); an empty list gives 0 for all.
    """
    entries = canonical.select(F.col(entry_col).cast("long").alias("entry"), F.col(label_col).alias("label"))
    entries = entries.filter("entry is not null and label is not null and trim(label) <> ''").groupBy("label").agg(F.min("entry").alias("entry"))
    typed = one_of_each(rows.select(F.col(id_col).alias("id"), F.col(value_col).alias("value")), "id")
    typed = stored(typed.filter(F.col("value").rlike(r"[^\s ]")).join(entries.select(F.col("label").alias("value")), "value", "left_anti"))
    best = stored(best_entries(typed.select("value").distinct(), entries))
    return typed.join(best, "value").select("id", F.coalesce("entry", F.lit(0)).alias("entry"), "score")
