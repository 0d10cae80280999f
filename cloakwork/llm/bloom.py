"""A set of words in a fixed number of bytes, which executors may hold however many words there are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a filter, of the pieces it is built in, and hash functions of a word. With 3.3 million words
#: one other word in a thousand is taken for one of them, with 7 million one in 75.
SIZE, PIECE, HASHES = 1 << 23, 1 << 14, 4
#: Copies of a piece that are merged at once in a first round come from this many salts.
SALTS = 64


def _places(word: str) -> list[int]:
    h = xxhash.xxh3_128_intdigest(word)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + k * b) % (SIZE * 8) for k in range(HASHES)]


class Bloom:
    """Words that were added are in it; others are in it by chance, the rarer the fewer words it has."""

    def __init__(self, pieces: dict[int, bytes]):
        self.pieces = pieces
        self._known: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        known = self._known.get(word)
        if known is None:
            known = all(self._bit(p) for p in _places(word))
            if len(self._known) < 200_000:
                self._known[word] = known
        return known

    def _bit(self, place: int) -> bool:
        piece = self.pieces.get(place // (PIECE * 8))
        return piece is not None and bool(piece[place % (PIECE * 8) >> 3] >> (place & 7) & 1)

    def __getstate__(self) -> dict[int, bytes]:
        return self.pieces

    def __setstate__(self, pieces: dict[int, bytes]) -> None:
        self.pieces, self._known = pieces, {}


def build(words: DataFrame) -> Bloom:
    """The filter of words(word). At most SIZE bytes come to the driver."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places = np.unique(np.array([p for w in pdf["word"] for p in _places(w)], dtype=np.int64))
            for piece in np.unique(places // (PIECE * 8)):
                own = places[places // (PIECE * 8) == piece] % (PIECE * 8)
                data = np.zeros(PIECE * 8, dtype=np.uint8)
                data[own] = 1
                yield pd.DataFrame({"piece": [int(piece)], "data": [np.packbits(data, bitorder="little").tobytes()]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE, dtype=np.uint8)
        for data in pdf["data"]:
            total |= np.frombuffer(data, dtype=np.uint8)
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "data": [total.tobytes()]})

    clean = words.select("word").filter(F.col("word").isNotNull())
    parts = clean.mapInPandas(bits, "piece long, data binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    once = parts.groupBy("piece", "salt").applyInPandas(lambda pdf: joined(pdf), "piece long, data binary")
    parts = once.groupBy("piece").applyInPandas(lambda pdf: joined(pdf), "piece long, data binary")
    return Bloom({r["piece"]: bytes(r["data"]) for r in parts.collect()})
