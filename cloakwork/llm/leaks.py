"""Problem 8: evaluation items that leaked into training text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.session import one_of_each

#: Words of an n-gram, words of a passage that count as a leak, and words of an alteration that a
#: passage bridges.
GRAM, PASSAGE, BRIDGE = 3, 10, 4
#: A passage must hold a word of at least this weight: one that few items have.
TELLING = 0.6
#: A passage must hold this much weight that tells its item from others (a word of one item only
#: weighs 1), and keep this share of the weight of the part of the item that it covers; of a LONG
#: passage, the second share is enough.
WEIGHT, KEEP, LONG, KEEP_LONG = 2.0, 0.85, 25, 0.7
#: Whatever its words weigh, a passage counts too if it keeps ten words of a dozen and has a run of up
#: to so many words that no other item has.
WORDS, RUN = 0.83, 6
#: Words of items that are broadcast at once, some 60 MB in a worker; a larger set of items is scanned
#: for in blocks.
BLOCK = 250_000

_word = re.compile(r"[^\W_]+")


def spans_of_words(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case, without punctuation, with their place in the text. An apostrophe parts words;
    ligatures and wide letters are plain ones, and what a character stands for lies where it does."""
    if text.isascii():
        return [(m.group().lower(), *m.span()) for m in _word.finditer(text)]
    return [(w, *m.span()) for m in _word.finditer(text) for w in _word.findall(unicodedata.normalize("NFKC", m.group()).lower())]


def words(text: str) -> list[str]:
    """The words of `spans_of_words`; most texts have their plain form already."""
    plain = text.isascii() or unicodedata.is_normalized("NFKC", text)
    return _word.findall(text.lower()) if plain else [w for w, _, _ in spans_of_words(text)]


@dataclass(frozen=True)
class Elsewhere:
    """What items of other blocks have of a block: how many hold each word, which runs of GRAM to RUN
    words any of them holds, and how many there are."""

    seen: dict[str, int]
    runs: frozenset[tuple[str, ...]]
    items: int


class Index:
    """n-grams of item bodies and how much each word tells items apart, over the items of all blocks."""

    def __init__(self, bodies: dict[int, list[str]], elsewhere: Elsewhere = Elsewhere({}, frozenset(), 0)):
        self.bodies = bodies
        self.shared = elsewhere.runs
        grams: dict[tuple[str, ...], set[int]] = defaultdict(set)
        seen: Counter[str] = Counter(elsewhere.seen)
        for item, body in bodies.items():
            seen.update(set(body))
            for gram in zip(*(body[k:] for k in range(GRAM))):
                grams[gram].add(item)
        self.grams = {g: tuple(sorted(i)) for g, i in grams.items()}
        every = len(bodies) + elsewhere.items + 1
        self.weight = {w: math.log(every / n) / math.log(every) for w, n in seen.items()}
        self.telling = {i: {w for w in b if self.weight[w] >= TELLING} for i, b in bodies.items()}

    def scan(self, text: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Items to the word ranges of the text that hold a passage of them."""
        hits: dict[int, list[int]] = defaultdict(list)
        telling: set[int] = set()
        # n-grams of the items hold only words of the items, so other windows need no look
        known = [at for at, w in enumerate(text) if w in self.weight]
        for first, last in zip(known, known[GRAM - 1 :]):
            if last - first == GRAM - 1 and (items := self.grams.get(tuple(text[first : last + 1]))):
                at = first
                for item in items:
                    hits[item].append(at)
                if len(items) == 1 and (not self.shared or tuple(text[first : last + 1]) not in self.shared):
                    telling.add(items[0])
        found = {}
        for item, places in hits.items():
            # ten words of a dozen, in three parts, leave four n-grams
            likely = item in telling or len(places) >= PASSAGE - GRAM
            if likely or len(places) >= PASSAGE - 2 * GRAM:
                passages = self._verify(item, text, places, likely)
                if passages:
                    found[item] = passages
        return found

    def _alone(self, item: int, run: list[str]) -> bool:
        """Whether up to RUN words in a row of this run stand in the item and in no other."""
        n = min(RUN, len(run))
        for at in range(len(run) - n + 1 if n >= GRAM else 0):
            part = tuple(run[at : at + n])
            have = set(self.grams.get(part[:GRAM], ()))
            for k in range(1, n - GRAM + 1):
                if len(have) < 2:
                    break
                have.intersection_update(self.grams.get(part[k : k + GRAM], ()))
            if item in have and part not in self.shared and not any(_holds(self.bodies[other], part) for other in have - {item}):
                return True
        return False

    def _verify(self, item: int, text: list[str], places: list[int], likely: bool) -> list[tuple[int, int]]:
        body, found = self.bodies[item], []
        around = len(body)
        start = 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k] - places[k - 1] > around:
                low, high = max(0, places[start] - around), min(len(text), places[k - 1] + GRAM + around)
                part = text[low:high]
                if likely and not self.telling[item].isdisjoint(part) or self._runs_alone(item, text, places[start:k]):
                    found += [(low + a, low + b) for a, b in self._passages(item, part)]
                start = k
        return found

    def _runs_alone(self, item: int, text: list[str], places: list[int]) -> bool:
        """Whether n-grams of the item at these places, enough for a passage, make up a run of it alone."""
        first = 0
        for k in range(1, len(places) + 1 if len(places) >= PASSAGE - 2 * GRAM else 0):
            if k == len(places) or places[k] - places[k - 1] > 1:
                if self._alone(item, text[places[first] : places[k - 1] + GRAM]):
                    return True
                first = k
        return False

    def _passages(self, item: int, part: list[str]) -> list[tuple[int, int]]:
        body = self.bodies[item]
        blocks = [b for b in SequenceMatcher(None, body, part, autojunk=False).get_matching_blocks() if b.size]
        chains: list[list] = []
        for b in blocks:
            last = chains[-1][-1] if chains else None
            if last and b.a - last.a - last.size <= BRIDGE and b.b - last.b - last.size <= BRIDGE:
                chains[-1].append(b)
            else:
                chains.append([b])
        found = []
        for chain in chains:
            while chain and chain[0].size == 1 and len(chain) > 1 and self.weight[body[chain[0].a]] < 0.5:
                chain = chain[1:]
            matched = sum(b.size for b in chain)
            whole = range(chain[0].a, chain[-1].a + chain[-1].size)
            weights = [self.weight[body[b.a + k]] for b in chain for k in range(b.size)]
            kept = sum(weights)
            total = sum(self.weight[body[k]] for k in whole)
            if matched >= PASSAGE and kept >= WEIGHT and max(weights) >= TELLING and kept >= total * (KEEP_LONG if matched >= LONG else KEEP):
                found.append((chain[0].b, chain[-1].b + chain[-1].size))
                continue
            while len(chain) > 1 and chain[-1].size == 1 and self.weight[body[chain[-1].a]] < 0.5:
                chain = chain[:-1]
            matched = sum(b.size for b in chain)
            most = max(chain[-1].a + chain[-1].size - chain[0].a, chain[-1].b + chain[-1].size - chain[0].b)
            if matched >= PASSAGE and matched >= most * WORDS and any(self._alone(item, body[b.a : b.a + b.size]) for b in chain):
                found.append((chain[0].b, chain[-1].b + chain[-1].size))
        return found


def _holds(body: list[str], run: tuple[str, ...]) -> bool:
    return any(body[k] == run[0] and tuple(body[k : k + len(run)]) == run for k in range(len(body) - len(run) + 1))


def _bodies(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, body of the items that count, once each: the text but for its first line, the instruction."""
    text = F.col(text_col)
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.when(F.contains(text, F.lit("\n")), F.expr(f"substring(`{text_col}`, locate('\n', `{text_col}`) + 1)")).alias("body"))
    return rows.filter("id is not null and body is not null").groupBy("id").agg(F.min("body").alias("body"))


def bodies(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[dict[int, list[str]]]:
    """Item bodies (all but the first line, the instruction) in blocks of at most BLOCK words.

    Null ids and items without a body don't count; of rows with one id the smallest body does. Items are
    a stated query set: they are read block by block, and each block is searched for in all documents.
    """
    block: dict[int, list[str]] = {}
    size = 0
    for row in _bodies(items, id_col, text_col).orderBy("id").toLocalIterator():
        body = words(row["body"])
        if len(body) < GRAM:
            continue
        if block and size + len(body) > BLOCK:
            yield block
            block, size = {}, 0
        block[row["id"]] = body
        size += len(body)
    if block:
        yield block


def elsewhere(items: DataFrame, block: dict[int, list[str]], id_col: str = "item_id", text_col: str = "text") -> Elsewhere:
    """What all items but the block's have of it, found by one distributed pass over the items. The answer
    is no larger than the block."""
    own_runs = {r for b in block.values() for n in range(GRAM, RUN + 1) for r in zip(*(b[k:] for k in range(n)))}
    shared = items.sparkSession.sparkContext.broadcast((frozenset(block), frozenset(w for b in block.values() for w in b), own_runs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vocabulary, runs = shared.value
        for pdf in batches:
            seen: Counter[str] = Counter()
            for item, text in zip(pdf["id"], pdf["body"]):
                body = words(text)
                if item not in ids and len(body) >= GRAM:
                    seen.update(vocabulary.intersection(body))
                    seen.update(" ".join(r) for r in runs.intersection(r for n in range(GRAM, RUN + 1) for r in zip(*(body[k:] for k in range(n)))))
                    seen[""] += 1
            yield pd.DataFrame({"run": list(seen), "n": list(seen.values())})

    rows = _bodies(items, id_col, text_col).mapInPandas(run, "run string, n long").groupBy("run").agg(F.sum("n").alias("n")).collect()
    found = {r["run"]: r["n"] for r in rows}
    others = found.pop("", 0)
    return Elsewhere({r: n for r, n in found.items() if " " not in r}, frozenset(tuple(r.split(" ")) for r in found if " " in r), others)


def indexes(items: DataFrame) -> Iterator[Index]:
    """An index of each block of items; words and runs are counted over all blocks, so that the result
    doesn't depend on how items fall into blocks."""
    blocks = bodies(items)
    block, several = next(blocks, None), False
    while block is not None:
        following = next(blocks, None)
        several |= following is not None
        yield Index(block, elsewhere(items, block)) if several else Index(block)
        block = following


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id for every document that holds an item's body or a passage of it.

    A passage has PASSAGE words or more in common with the body, in order, bridging alterations of up
    to BRIDGE words, and keeps most of what tells the item from others, or most of the words and a run
    of them that no other item has. Texts are scanned whole. Null
    ids, null and empty texts give no rows; each pair comes once; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    out = spark.createDataFrame([], "doc_id long, item_id long")
    for each in indexes(items):
        index = spark.sparkContext.broadcast(each)

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(doc, item) for doc, text in zip(pdf["doc_id"], pdf["text"]) for item in index.value.scan(words(text))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        out = out.union(docs.mapInPandas(run, "doc_id long, item_id long"))
    return out.distinct()


def cleaned(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with leaked passages cut out of the text; items: the items that leaked, sorted.

    Columns: doc_id, text, items. Null texts stay null. The order of blocks doesn't matter.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.array().cast("array<long>").alias("items"))
    for each in indexes(items):
        index = spark.sparkContext.broadcast(each)

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts, lists = [], []
                for text, have in zip(pdf["text"], pdf["items"]):
                    have = list(have)
                    if text:
                        places = spans_of_words(text)
                        found = index.value.scan([w for w, _, _ in places])
                        have = sorted({*have, *found})
                        cuts = sorted(r for ranges in found.values() for r in ranges)
                        kept, at = [], 0
                        for a, b in cuts:
                            if places[b - 1][2] > at:
                                kept.append(text[at : max(at, places[a][1])])
                                at = places[b - 1][2]
                        text = "".join(kept) + text[at:]
                    texts.append(text)
                    lists.append(have)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "items": lists})

        docs = docs.mapInPandas(run, "doc_id long, text string, items array<long>")
    return one_of_each(docs, "doc_id")
