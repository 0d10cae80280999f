"""Problem 7: texts packed into containers of fixed capacity, by multiway differencing."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.session import one_of_each, stored, tasks

#: Tokens, as a multiple of the capacity, of the texts that are packed together. Each group of texts
#: wastes less than one container by rounding, so some 1 / GROUP of the space at most.
GROUP = 96
#: Texts of a group at most, on average, however short they are; kinds of containers at most.
GROUP_ITEMS, KINDS = 20_000, 1000
#: Where the vocabulary files of public tokenizers are, unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters that are encoded at a time; a longer text is encoded in parts, cut at white space.
PART = 20_000


def load_tokenizer(path: str = VOCABULARY):
    """A byte-level BPE encoding from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, each but the first beginning with white space."""
    at = 0
    while len(text) - at > PART:
        cut = at + PART
        while cut > at + 1 and not (text[cut].isspace() and not text[cut - 1].isspace()):
            cut -= 1
        if cut == at + 1:
            cut = at + PART
        yield text[at:cut]
        at = cut
    yield text[at:]


_tokenizers: dict[str, object] = {}


def count_tokens(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens of every document with an id, once each; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _tokenizers:
            _tokenizers[vocabulary] = load_tokenizer(vocabulary)
        encode = _tokenizers[vocabulary].encode_ordinary
        for pdf in batches:
            sizes = [sum(len(encode(p)) for p in parts_of(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": sizes})

    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    return one_of_each(docs.mapInPandas(run, "doc_id long, tokens long"), "doc_id")


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Indexes of sizes in `ways` subsets of near-equal sums, by Karmarkar and Karp's largest
    differencing for many ways: the two partial partitions with the widest spread merge, the largest
    subset of one with the smallest of the other. Subsets still empty aren't stored."""
    # a partial partition: subset sums in falling order (only the non-empty) and their members
    heap = [(-s, k, [s], [[k]]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a_sums, a_sets = heapq.heappop(heap)
        _, _, b_sums, b_sets = heapq.heappop(heap)
        free = ways - len(a_sums)
        # b's largest go to a's empty subsets, then to a's smallest
        sums, sets = list(a_sums), list(a_sets)
        sums += b_sums[:free]
        sets += b_sets[:free]
        for k in range(free, len(b_sums)):
            at = len(a_sums) - 1 - (k - free)
            sums[at] += b_sums[k]
            sets[at] = sets[at] + b_sets[k]
        order = sorted(range(len(sums)), key=lambda i: -sums[i])
        sums, sets = [sums[i] for i in order], [sets[i] for i in order]
        spread = sums[0] - (sums[-1] if len(sums) == ways else 0)
        heapq.heappush(heap, (-spread, serial, sums, sets))
        serial += 1
    return [s for s in heap[0][3]] if heap else []


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item, none over capacity; no item may be larger than the capacity.

    The number of containers starts at the least possible and rises whenever differencing leaves one
    too full. Rises double while they fail, and the last step is bisected.
    """
    if not sizes:
        return []
    least = max(1, -(-sum(sizes) // capacity))

    def fits(ways: int) -> list[list[int]] | None:
        if ways >= len(sizes):
            return [[k] for k in range(len(sizes))]
        sets = differencing(sizes, ways)
        return sets if all(sum(sizes[i] for i in s) <= capacity for s in sets) else None

    step, low, best, ways = 1, least - 1, None, least
    while (best := fits(ways)) is None:
        low, ways = ways, ways + step
        step *= 2
    high = ways
    while high - low > 1:
        middle = (low + high) // 2
        found = fits(middle)
        if found is None:
            low = middle
        else:
            high, best = middle, found
    out = [0] * len(sizes)
    for number, items in enumerate(best):
        for i in items:
            out[i] = number
    return out


def assigned(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """container, window, doc_id, part, start, tokens: every document's place for every container size.

    sizes(doc_id, tokens), containers(container, capacity_tokens). A document larger than the capacity
    is split, only then, into parts that fill whole windows and a rest that is packed like a document;
    part numbers its parts from 0 and start is the first token's place. Documents without tokens take no
    place. Windows are numbered within groups of documents: window is "group-number". Containers
    without a positive capacity have no rows.
    """
    caps = containers.select("container", F.col("capacity_tokens").cast("long").alias("capacity")).filter("container is not null and capacity > 0")
    kinds = [(r["container"], r["capacity"]) for r in caps.groupBy("container").agg(F.min("capacity").alias("capacity")).orderBy("container").limit(KINDS + 1).collect()]
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    each = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("long").alias("capacity")) for c, n in kinds]) if kinds else F.expr("cast(array() as array<struct<container:string,capacity:bigint>>)")
    sizes = stored(sizes)  # tokens are counted once
    items = sizes.filter("tokens > 0").select("doc_id", "tokens", F.inline(each))
    full = items.filter("tokens > capacity").select("container", "capacity", "doc_id", "tokens", F.explode(F.expr("sequence(0L, (tokens - 1) div capacity)")).alias("part"))
    full = full.withColumn("start", F.col("part") * F.col("capacity")).withColumn("tokens", F.expr("least(capacity, tokens - start)"))
    whole = items.filter("tokens <= capacity").select("container", "capacity", "doc_id", "tokens", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("start"))
    pieces = full.select(*whole.columns).unionByName(whole)
    filled = pieces.filter("tokens = capacity").select("container", F.format_string("%d.%d", "doc_id", "part").alias("window"), "doc_id", "part", "start", "tokens")
    rest = stored(pieces.filter("tokens < capacity"))
    # as many groups as the tokens of the container's items fill, whatever the number of items
    totals = stored(rest.groupBy("container").agg(F.sum("tokens").alias("total"), F.count("*").alias("pieces")))
    groups = rest.join(totals, "container").withColumn("grp", F.expr(f"pmod(xxhash64(doc_id, part), greatest(1, total div (capacity * {GROUP}), pieces div {GROUP_ITEMS}))"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True])
        numbers = pack([int(x) for x in pdf["tokens"]], int(pdf["capacity"].iloc[0]))
        pdf = pdf.assign(window=[f"g{g}-{n}" for g, n in zip(pdf["grp"], numbers)])
        return pdf[["container", "window", "doc_id", "part", "start", "tokens"]]

    # packing takes long for its few bytes: as many tasks as cores want, not as bytes would
    groups = groups.repartition(tasks(sizes.sparkSession), "container", "grp")
    packed = groups.groupBy("container", "grp").applyInPandas(run, "container string, window string, doc_id long, part long, start long, tokens long")
    return filled.unionByName(packed)


def usage(places: DataFrame, containers: DataFrame) -> DataFrame:
    """container, windows, tokens, used: the share of the windows' space that holds tokens, and most:
    the fullest window's tokens."""
    windows = places.groupBy("container", "window").agg(F.sum("tokens").alias("tokens"))
    sums = windows.groupBy("container").agg(F.count("*").alias("windows"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))
    return sums.join(containers.select("container", F.col("capacity_tokens").alias("capacity")), "container").withColumn("used", F.col("tokens") / (F.col("windows") * F.col("capacity")))
