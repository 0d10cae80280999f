"""Problem 9: keyword-stuffed pages, link lists and tag lists."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.session import one_of_each, stored

# Frequent function words of the languages whose pages are told apart.
FUNCTION_WORDS = {
    "en": "the a an of and to in is was were for that on with by as at it its from this be are has have had not or but if which who will may no one since so until what after before under than there their they we you our your i he she his her him them been being into when where while would could should about after all any because how",
    "es": "el la los las un una de del y a al en es fue ha han por para que se con no lo su sus como más pero o este esta le ya muy sin sobre entre cuando hay ni según tras antes además todavía ningún junto está nos",
    "fr": "le la les un une de des du et à au aux en est été a ont pour par que qui se sur avec ne pas ce cette son sa ses dans ou mais nous vous il elle plus sans lors encore quand aucun avant sous selon outre n'a c l d s n qu",
    "de": "der die das den dem des ein eine einen einem einer und zu in im ist war wurde werden hat haben auf für von mit nicht als an am bis bei durch nach noch aus sich es sie wir uns so oder aber kein keine bitte unter vor um dass laut zum zur solche dieser gilt",
    "it": "il lo la i gli le un una di del della dei e a al alla in nel è stato ha hanno per che si con non su sul ci come più ma o da dal dalla questo entro ancora quando nessun dopo prima inoltre secondo alcun",
    "pt": "o a os as um uma de do da dos das e em no na nos nas é foi ha há por para que se com não ao à ou mas como mais até depois ainda sua seu quando nenhum este antes além segundo havia pelo pela",
    "nl": "de het een van en in is was te op voor met niet aan er dat die zijn wordt werd heeft hebben door om bij als of maar geen ook naar uit nog tot na onder deze wij we u dit volgens toen alstublieft kan",
}
_FW = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}

FEATURES = ("marks", "keywords", "repeats", "sameness", "figures")
#: Characters that are added to the marked and to the other characters before their odds are taken: about
#: one link's. A text counts as LEAST other characters at least, as one with hardly any tells nothing.
ADDED, LEAST = 40.0, 60.0
#: What is added to each feature's spread, as a spread that regularises: a feature that is constant in a
#: language's clean text still needs a unit. The spread of marks comes from the texts alone.
FLOOR = (0.01, 0.06, 0.06, 0.05, 0.08)
#: Chance of a clean text to be as far out as a marked page, if features were normal; and the square root
#: of that chi-square quantile with one degree of freedom.
CHANCE, FAR = 0.0005, 3.481
#: Features that keyword stuffing raises, the distance from which it counts, and deviations of single
#: features that it needs: function words must be missing, so that a text that only repeats itself is
#: none, and figures must not abound, so that tables and inventories aren't.
STUFFING, STUFFED = (1, 2, 3), 8.15
NEEDS = {"keywords": (2.0, math.inf), "figures": (-math.inf, 2.5)}
#: Words of a window in which repetition is measured.
WINDOW = 60

_link = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*", re.I)
_path = re.compile(r"\.[\w-]+/")
_tag = re.compile(r"(?<!\w)#+[^\W_]\w{2,}")
_token = re.compile(r"#?\d*[^\W\d_]+(?:['’][^\W\d_]+)?|#\d+|\d[\d.,:/-]*")


def features(text: str) -> tuple[float, ...]:
    """marks: log odds of a non-blank character to lie in a link or a hash tag, shrunk by ADDED. keywords:
    share of the words outside links that stand in runs without function words. repeats: share of word
    pairs in runs that came before within a window. sameness: how far word entropy is below that of as
    many different words. figures: share of numbers. All but the first lie in 0..1."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    solid = max(1, sum(map(len, text.split())))
    linked = tagged = 0

    def link(m: re.Match) -> str:
        nonlocal linked
        linked += len(m.group())
        return " "

    def tag(m: re.Match) -> str:
        nonlocal tagged
        tagged += len(m.group())
        return " "

    rest, low = text, text.lower()
    if "://" in low or "www." in low or _path.search(low):
        rest = _link.sub(link, rest)
    if "#" in rest:
        rest = _tag.sub(tag, rest)
    marked = linked + tagged
    marks = math.log((marked + ADDED) / (max(solid - marked, LEAST) + ADDED))
    tokens = _token.findall(low if rest is text else rest.lower())
    words = [t for t in tokens if t[0] > "9" or t[0] == "#"]
    figures = 1 - len(words) / len(tokens) if tokens else 0.0
    if not words:
        return (marks, 0.0, 0.0, 0.0, figures)
    tally = Counter(words)
    best = max(_FW.values(), key=lambda fw: sum(n for w, n in tally.items() if w in fw))
    dense = run = repeated = 0
    seen: dict[tuple[str, str], int] = {}
    for w in words:
        if w in best:
            run = 0
        else:
            run += 1
            if run >= 4:
                dense += 4 if run == 4 else 1
    for at, pair in enumerate(zip(words, words[1:])):
        if at - seen.get(pair, -WINDOW - 1) <= WINDOW:
            repeated += 1
        seen[pair] = at
    counts = np.fromiter(tally.values(), dtype=float) / len(words)
    entropy = -float(np.sum(counts * np.log(counts)))
    usual = math.log(len(words)) if len(words) > 1 else 1.0
    sameness = max(0.0, 1 - entropy / min(usual, math.log(150))) if len(words) > 1 else 0.0
    # the parts outside links and tags count by their share of the text
    share = max(0.0, 1 - marked / solid)
    few = min(1.0, len(words) / 12)
    return (marks, share * few * dense / len(words), share * few * repeated / max(1, len(words) - 1), share * few * sameness, figures)


def language(lang: Column) -> Column:
    """The two letters of a known language label, else other."""
    short = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(short.isin(*FUNCTION_WORDS), short).otherwise(F.lit("other"))


def measured(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang and the features of every document that has a text with a non-blank character."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [features(t) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=list(FEATURES), dtype=float)
            out.insert(0, "lang", pdf["lang"].to_numpy())
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), language(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    return docs.mapInPandas(run, "doc_id long, lang string, " + ", ".join(f"{f} double" for f in FEATURES))


def _moments(rows: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Per language: number of rows, mean, covariance; one aggregation, at most eight rows come back."""
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.groupBy("lang").agg(F.count("*").alias("n"), *sums).collect():
        mean = np.array([r[f"s{i}"] for i in range(len(FEATURES))]) / r["n"]
        cov = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
        out[r["lang"]] = (r["n"], mean, cov)
    return out


def _distance(rows: DataFrame, model: dict[str, tuple[np.ndarray, np.ndarray]]) -> Column:
    """Squared Mahalanobis distance to the centre of the row's language, as a column expression."""
    out = F.lit(None).cast("double")
    for lang, (mean, inverse) in model.items():
        z = [F.col(f) - float(m) for f, m in zip(FEATURES, mean)]
        total = F.lit(0.0)
        for i in range(len(FEATURES)):
            for j in range(i, len(FEATURES)):
                total = total + z[i] * z[j] * float(inverse[i, j] * (1 if i == j else 2))
        out = F.when(F.col("lang") == lang, total).otherwise(out)
    return out


def fitted(rows: DataFrame, steps: int = 3) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language, a robust centre and the inverse of a robust covariance.

    The start is each feature's median and median deviation; concentration steps then take mean and
    covariance of the rows whose distance is below a chi-square bound, over all rows of the language.
    A language with few rows is drawn towards the centre and spread of all languages together.
    """
    medians = {r["lang"]: r["m"] for r in rows.groupBy("lang").agg(F.array(*[F.percentile_approx(f, 0.5, 1000) for f in FEATURES]).alias("m")).collect()}
    if not medians:
        return {}
    deviation = rows
    for i, f in enumerate(FEATURES):
        middle = F.lit(None).cast("double")
        for lang, m in medians.items():
            middle = F.when(F.col("lang") == lang, float(m[i])).otherwise(middle)
        deviation = deviation.withColumn(f, F.abs(F.col(f) - middle))
    spread = {r["lang"]: r["m"] for r in deviation.groupBy("lang").agg(F.array(*[F.percentile_approx(f, 0.5, 1000) for f in FEATURES]).alias("m")).collect()}
    floor = np.array(FLOOR)
    model = {k: (np.array(m), np.diag(1 / np.maximum(1.4826 * np.array(spread[k]), floor) ** 2)) for k, m in medians.items()}
    bound = 18.0  # about the 0.997 point of chi-square with five degrees of freedom
    for _ in range(steps):
        moments = _moments(rows.filter(_distance(rows, model) <= bound))
        if not moments:
            break
        n = sum(m[0] for m in moments.values())
        mean = sum(m[0] * m[1] for m in moments.values()) / n
        cov = sum(m[0] * (m[2] + np.outer(m[1] - mean, m[1] - mean)) for m in moments.values()) / n
        for lang in model:
            k, own_mean, own_cov = moments.get(lang, (0, mean, cov))
            w = k / (k + 50)
            both = w * own_cov + (1 - w) * cov
            model[lang] = (w * own_mean + (1 - w) * mean, np.linalg.inv(both + np.diag(floor**2)))
    return model


def spam(rows: DataFrame, model: dict[str, tuple[np.ndarray, np.ndarray]], cosine: float = 0.97) -> DataFrame:
    """doc_id, marked, stuffed, direction (0 marks, 1 stuffing) of the outliers in directions of spam.

    marked: robust distance in the direction of links and tags, in units of FAR; 0 for odds that a text
    without any may have. stuffed: robust
    distance, in units of STUFFED, of a row whose offset leads towards keyword stuffing: its cosine to
    the span of those features, in the space where the language's features are uncorrelated and of unit
    spread, must reach `cosine`, the features must rise, and it must have what stuffing NEEDS. Marks
    are left out of that cosine, so pages of both kinds count; of these the squares of the two add up.
    A row is spam from 1 on.
    """
    spread = {k: (m, np.linalg.inv(inverse)) for k, (m, inverse) in model.items()}
    words = list(range(1, len(FEATURES)))
    unmarked = math.log(ADDED / (LEAST + ADDED))  # the odds that a short text without marks has

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(FEATURES)].to_numpy()
            marked, stuffed = np.zeros(len(pdf)), np.zeros(len(pdf))
            for lang, (mean, cov) in spread.items():
                own = np.flatnonzero((pdf["lang"] == lang).to_numpy())
                offset = x[own] - mean
                deviation = offset / np.sqrt(np.diag(cov))
                marked[own] = np.where(x[own, 0] > unmarked, np.maximum(deviation[:, 0], 0), 0) / FAR
                root = np.linalg.cholesky(np.linalg.inv(cov[np.ix_(words, words)])).T
                z = offset[:, words] @ root.T
                distance = np.linalg.norm(z, axis=1)
                basis = np.linalg.qr(root[:, [k - 1 for k in STUFFING]])[0]
                meets = (offset[:, list(STUFFING)].sum(axis=1) > 0) & (np.linalg.norm(z @ basis, axis=1) >= cosine * distance)
                for f, (least, most) in NEEDS.items():
                    meets &= (deviation[:, FEATURES.index(f)] >= least) & (deviation[:, FEATURES.index(f)] <= most)
                stuffed[own] = np.where(meets, distance / STUFFED, 0)
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "marked": marked, "stuffed": stuffed, "direction": (stuffed > marked).astype(np.int64)})
            yield out[marked**2 + stuffed**2 >= 1]

    return rows.mapInPandas(run, "doc_id long, marked double, stuffed double, direction long")


def found(documents: DataFrame, **columns: str) -> DataFrame:
    """doc_id of every spam page; each document once. Null ids and null or blank texts give no rows."""
    rows = stored(one_of_each(measured(documents, **columns), "doc_id"))
    return spam(rows, fitted(rows)).select("doc_id")
