"""Problem 5: the language of documents and of passages, by cross-parsing against labelled text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.session import stored

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt")
#: Bounds of the fit, and of nothing that is judged: it reads about this many different texts of a
#: language, whole; keeps at most this many different sentences of them, those that most texts share
#: first, of at most PIECE_CHARS letters; and builds the language's automaton from at most this many letters.
SAMPLE_TEXTS, SAMPLE_PIECES, PIECE_CHARS, SAMPLE_CHARS = 3000, 3000, 400, 24_000
#: Bits that another language must save to be worth a change of language between two sentences, and to
#: call a passage foreign in a document of another language. Two phrases cost some 29 bits.
#: MARGIN: the share of its cost in the document's language that a foreign passage must save.
SWITCH, GAIN, MARGIN = 30.0, 30.0, 0.4
#: Letters of the automata: a to z and the blank.
ALPHABET = 27

# not after an initial, nor after a stop that stands by itself
_cut = re.compile(r"(?<=[^\s.][.!?;])(?<!\b[A-Za-z]\.)\s+(?=\S)|\s+[/|]\s+|\s+--\s+|\n\s*\n")
_address = re.compile(r"\S*\s?(?:@|[\[(]at[\])])\s?\S*(?:\s\.\s\S+)*|\b\S*\d\S*", re.I)


_word = re.compile(r"[^\W\d_]+")


def shouted(sentence: str) -> bool:
    """Whether a sentence is mostly in capitals."""
    return sum(map(str.isupper, sentence)) * 2 > sum(map(str.isalpha, sentence))


def unnamed(sentence: str) -> str:
    """The sentence without its capitalised words, which name people and places as often as things;
    a first word stays unless another capitalised word follows it. A sentence mostly in capitals stays
    whole."""
    words = list(_word.finditer(sentence))
    if not words or shouted(sentence):
        return sentence
    capital = [m.group()[0].isupper() for m in words]
    out, at = [], 0
    for k, m in enumerate(words):
        if capital[k] and (k or capital[1:2] == [True]):
            out.append(sentence[at : m.start()])
            at = m.end()
    return "".join(out) + sentence[at:]


def letters(sentence: str, known: frozenset[str] | None = None) -> str:
    """The sentence in the automata's alphabet: lower case without accents; names, words with digits,
    mail addresses and all other characters become one blank. known: words of any language; capitals
    hide which words are names, so a sentence in capitals keeps these words only, if it has any."""
    text = unnamed(_address.sub(" ", sentence))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
        text = "".join(c for c in text if not unicodedata.combining(c))
    text = text.lower()
    text = re.sub(r"[^a-z]+", " ", text).strip()
    if known is not None and shouted(sentence):
        text = " ".join(w for w in text.split() if w in known) or text
    return text


class Automaton:
    """Suffix automaton of a text: from the root, exactly the text's substrings can be read."""

    def __init__(self, text: str):
        codes = encode(text)
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in codes:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.table = np.zeros((len(nxt), ALPHABET), dtype=np.int32)
        for s, moves in enumerate(nxt):
            for c, t in moves.items():
                self.table[s, c] = t


def encode(text: str) -> list[int]:
    return [0 if c == " " else ord(c) - 96 for c in text]


def phrases(tables: list[np.ndarray], texts: list[str]) -> np.ndarray:
    """For each text and automaton, the number of phrases of the cross-parsing: the text is cut, from
    the left, into longest pieces that the automaton's text contains. All texts advance together."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order])
    most = int(lengths[0]) if len(lengths) else 0
    codes = np.zeros((len(texts), most), dtype=np.int8)
    for row, i in enumerate(order):
        codes[row, : lengths[row]] = encode(texts[i])
    counts = np.zeros((len(texts), len(tables)), dtype=np.int32)
    alive = np.searchsorted(-lengths, -np.arange(most), side="left")  # texts longer than each position
    for a, table in enumerate(tables):
        flat = table.ravel()
        state = np.zeros(len(texts), dtype=np.int64)
        for at in range(most):
            n = alive[at]
            c = codes[:n, at]
            to = flat[state[:n] * ALPHABET + c]
            stuck = to == 0
            # a phrase begins at the start, after a letter that the text lacks, and where none goes on
            counts[:n, a] += stuck | (state[:n] == 0)
            state[:n] = np.where(stuck, flat[c], to)
    out = np.empty_like(counts)
    out[order] = counts
    return out


class Model:
    """Automata of languages. `bits` gives what each text costs by the cross-parsing with each."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.tables = [Automaton(texts[k]).table for k in self.languages]
        self.words = frozenset(w for t in texts.values() for w in t.split())
        # a phrase is named by its place in the automaton's text: longer texts make longer phrases, but
        # dearer ones
        self.price = np.array([math.log2(max(2, len(texts[k]))) for k in self.languages])

    def __getstate__(self) -> tuple:
        moves = [np.nonzero(t) for t in self.tables]
        return self.languages, self.words, self.price, [(len(t), (at[0] * ALPHABET + at[1]).astype(np.int32), t[at]) for t, at in zip(self.tables, moves)]

    def __setstate__(self, state: tuple) -> None:
        self.languages, self.words, self.price, self.tables = *state[:3], []
        for size, at, to in state[3]:
            table = np.zeros(size * ALPHABET, dtype=np.int32)
            table[at] = to
            self.tables.append(table.reshape(size, ALPHABET))

    def bits(self, texts: list[str]) -> np.ndarray:
        """Phrases times their price, a row per text that `letters` made; 0 for texts without letters."""
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), 4096):
            part = texts[at : at + 4096]
            out[at : at + len(part)] = phrases(self.tables, [f" {t} " if t else "" for t in part]) * self.price
        return out


def clean_sample(rows: list[tuple[str, str, float]]) -> dict[str, str]:
    """Labelled sentences (lang, sentence as `letters` gives it, weight) whose words speak for their label,
    joined in order up to SAMPLE_CHARS per language.

    Some labels are wrong, but for each word more texts of its language are labelled rightly than texts
    of it wrongly in any one way. So a sentence stays under its label if, over its words, the weight of
    sentences of that label beats that of every other label.
    """
    counts: dict[str, Counter[str]] = defaultdict(Counter)
    pieces: dict[str, Counter[str]] = defaultdict(Counter)
    for lang, piece, weight in rows:
        pieces[lang][piece] += weight
        for w in set(piece.split()):
            counts[lang][w] += weight

    logs = {k: {w: math.log(n + 0.1) for w, n in c.items()} for k, c in counts.items()}
    none = math.log(0.1)

    def outvoted(lang: str, sentence: str) -> bool:
        words = sentence.split()
        votes = {k: sum(own.get(w, none) for w in words) for k, own in logs.items()}
        return any(k != lang and (votes[k] >= votes[lang] or pieces[k][sentence] > pieces[lang][sentence]) for k in logs)

    out = {}
    for lang in sorted(pieces):
        kept, size = [], 0
        for sentence in pieces[lang]:
            if size + len(sentence) <= SAMPLE_CHARS and not outvoted(lang, sentence):
                kept.append(sentence)
                size += len(sentence) + 1
        if kept:
            out[lang] = " " + " ".join(kept) + " "
    return out


def label(lang: Column) -> Column:
    """The language that a label names, in two lower-case letters; null if it names none of the known."""
    short = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(short.isin(*LANGUAGES), short)


def fit(labelled: DataFrame, seed: int = 0) -> Model:
    """The model of labelled(lang, text), from a bounded sample of each language's different texts.

    Texts are chosen by hash and seed, so that of copies one counts, and read whole; their sentences are
    counted before anything comes to the driver, but for those in capitals, which hide their names. Rows with an unknown label or without text don't count.
    Languages without a clean sentence have no automaton; with no languages at all nothing can be judged.
    """
    rows = labelled.select(label(F.col("lang")).alias("lang"), "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return Model({})
    bound = F.lit(0)
    for lang, n in sizes.items():
        bound = F.when(F.col("lang") == lang, int((1 << 30) * min(1.0, SAMPLE_TEXTS / n))).otherwise(bound)
    sample = rows.filter(F.pmod("h", F.lit(1 << 30)) < bound).select("lang", "text").dropDuplicates(["lang", "text"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tally: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(pdf["lang"], pdf["text"]):
                tally.update({(lang, piece) for _, _, s in sentences(text) if not shouted(s) and 4 < len(piece := letters(s)) <= PIECE_CHARS})
                tally[lang, ""] += 1
            yield pd.DataFrame([(*k, n) for k, n in tally.items()], columns=["lang", "piece", "n"])

    pieces = sample.mapInPandas(cut, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64(F.lit(seed), "piece"), "piece")
    kept = pieces.withColumn("place", F.row_number().over(order)).filter((F.col("place") <= SAMPLE_PIECES) | (F.col("piece") == "")).orderBy("lang", "place").collect()
    read = {r["lang"]: r["n"] for r in kept if not r["piece"]}
    return Model(clean_sample([(r["lang"], r["piece"], r["n"] * sizes[r["lang"]] / read[r["lang"]]) for r in kept if r["piece"]]))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence) of the whole text."""
    out, at = [], 0
    for m in _cut.finditer(text):
        if m.start() > at:
            out.append((at, m.start(), text[at : m.start()]))
        at = m.end()
    if at < len(text):
        out.append((at, len(text), text[at:]))
    return out


def smoothed(costs: np.ndarray, starts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """For each sentence the language on its text's cheapest path: the costs of its sentences, plus
    `switch` for each change of language. starts: the row of costs with which each text begins. Texts
    advance together; of equally cheap ways the one without a change wins, then the first language."""
    lengths = np.diff(np.append(starts, len(costs)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    most = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(most), side="left")
    back = np.zeros(costs.shape, dtype=np.int8)
    every = np.arange(costs.shape[1])
    total = costs[starts].copy()
    for at in range(1, most):
        n = alive[at]
        best = total[:n].argmin(axis=1)
        jump = total[np.arange(n), best] + switch
        stays = total[:n] <= jump[:, None]
        back[starts[:n] + at] = np.where(stays, every, best[:, None])
        total[:n] = np.where(stays, total[:n], jump[:, None]) + costs[starts[:n] + at]
    out = np.zeros(len(costs), dtype=np.int64)
    state = total.argmin(axis=1)
    for at in range(most - 1, -1, -1):
        n = alive[at]
        out[starts[:n] + at] = state[:n]
        state[:n] = back[starts[:n] + at, state[:n]]
    return out


def segments(rows: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows(id, text) to segments(id, start, end, lang, confidence, size, bits): maximal runs of sentences
    of one language, with 0-based code-point offsets, the number of letters, and what the run costs in
    each of the model's languages.

    The language with the fewest normalised phrases wins, over the runs that the sentences of a text fall
    into at least cost; so a sentence that says too little by itself goes with its neighbours.
    confidence is 1 - the run's cost over that in the next language. Texts without letters have no
    segment. Whole texts are read. keep: string columns to carry along.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            parts = [(i, a, b, letters(s, model.words)) for i, t in enumerate(pdf["text"]) for a, b, s in sentences(t)]
            sounding = {p[0] for p in parts if p[3]} if model.languages else set()
            parts = [p for p in parts if p[0] in sounding]
            owner = np.array([p[0] for p in parts], dtype=np.int64)
            costs = model.bits([p[3] for p in parts])
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = smoothed(costs, first) if len(parts) else owner
            heads = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(best, prepend=-1) != 0))
            ends = np.append(heads, len(parts))[1:] - 1
            sums = np.add.reduceat(costs, heads, axis=0) if len(parts) else costs
            sizes = np.add.reduceat([len(p[3]) for p in parts], heads) if len(parts) else owner
            lang = best[heads]
            own = sums[np.arange(len(heads)), lang]
            others = sums.copy()
            others[np.arange(len(heads)), lang] = np.inf
            sure = np.clip(1 - own / np.maximum(others.min(axis=1, initial=np.inf), 1e-9), 0, 1)
            at = owner[heads]
            yield pd.DataFrame(
                {
                    "id": pdf["id"].to_numpy()[at], "start": [parts[k][1] for k in heads], "end": [parts[k][2] for k in ends], "lang": np.array(model.languages, dtype=object)[lang],
                    "confidence": sure, "size": sizes, "bits": pd.Series(list(sums), dtype=object), **{c: pdf[c].to_numpy()[at] for c in keep},
                }
            )

    clean = rows.select("id", *keep, "text").filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    return clean.mapInPandas(run, "id long, start int, end int, lang string, confidence double, size int, bits array<double>" + "".join(f", {c} string" for c in keep))


def documents(parts: DataFrame) -> DataFrame:
    """parts(doc_id, lang, confidence, start, end) to doc_id, lang, confidence: the language of most text.

    confidence is the language's share of the text times its mean confidence. Ties go to the language
    that comes first by name.
    """
    size = F.col("end") - F.col("start")
    sums = parts.groupBy("doc_id", "lang").agg(F.sum(size).alias("size"), F.sum(F.col("confidence") * size).alias("sure"))
    best = sums.groupBy("doc_id").agg(F.sum("size").alias("total"), F.max(F.struct("size", F.struct(*[(F.lit(0) - F.ascii(F.substring("lang", k, 1))).alias(f"o{k}") for k in (1, 2)]).alias("order"), "lang", "sure")).alias("b"))
    return best.select("doc_id", F.col("b.lang").alias("lang"), (F.col("b.sure") / F.col("total")).alias("confidence"))


def found(spans: DataFrame, docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, span_id, lang: documents whose label is missing or wrong (span_id 0, main language), and
    paragraphs that are wholly or partly in another language than the document's main one: it must
    save GAIN bits over the main one.

    spans(span_id, doc_id, block_type, text): each span once; only paragraphs with letters are judged.
    docs(doc_id, lang): the first label by name if a document has several. labelled(lang, text) fits
    the model. Paragraphs of documents that docs doesn't hold count as unlabelled.
    """
    model = fit(labelled)
    prose = spans.filter((F.col("block_type") == "paragraph") & F.col("doc_id").isNotNull()).select(F.col("span_id").cast("long").alias("id"), "doc_id", "text")
    # a paragraph sent twice gives the same segments twice: these are told apart, not the texts
    parts = stored(segments(prose, model, ("doc_id",)).dropDuplicates(["id", "start"]))
    main = stored(documents(parts))
    labels = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label(F.col("lang"))).alias("label"))
    wrong = main.join(labels, "doc_id", "left").filter(~F.col("label").eqNullSafe(F.col("lang"))).select("doc_id", F.lit(0).cast("long").alias("span_id"), "lang")
    other = parts.join(main.select("doc_id", F.col("lang").alias("main")), "doc_id").filter(F.col("lang") != F.col("main"))
    known = F.array(*[F.lit(k) for k in model.languages or LANGUAGES])
    in_main, own = (F.col("bits")[(F.array_position(known, F.col(c)) - 1).cast("int")] for c in ("main", "lang"))
    other = other.filter((in_main - own >= GAIN) & (in_main - own >= MARGIN * in_main))
    return wrong.unionByName(other.select("doc_id", F.col("id").alias("span_id"), "lang").distinct())
