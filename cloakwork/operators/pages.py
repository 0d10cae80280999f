"""Files with pages: what a codec reads from them, and files written again without what boxes cover.

Decoding PDF files and pictures needs a library; a codec is the place for it. `PlainPages` is the codec
of plain text with pages, and what the tests and queries run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Codec(Protocol):
    """Reads and rewrites the bytes of one kind of file. Both methods may raise on a broken file."""

    def words(self, content: bytes) -> list[tuple[int, int, str, int, int, int, int]]:
        """(page, ord, text, x, y, w, h) of every word, pages from 0."""

    def without(self, content: bytes, boxes: list[tuple[int, int, int, int, int]]) -> bytes:
        """The file without what lies in boxes (page, x, y, w, h), and without metadata."""


class PlainPages:
    """UTF-8 text: a form feed parts pages, a line break rows; a character is CELL wide and ROW high. Lines
    at the start of a file that begin with "%%" are its metadata."""

    CELL, ROW = 6, 12

    def _pages(self, content: bytes) -> list[list[str]]:
        lines = content.decode("utf-8").split("\n")
        while lines and lines[0].startswith("%%"):
            lines = lines[1:]
        return [page.split("\n") for page in "\n".join(lines).split("\f")]

    def words(self, content: bytes) -> list[tuple[int, int, str, int, int, int, int]]:
        out = []
        for page, lines in enumerate(self._pages(content)):
            order = 0
            for row, line in enumerate(lines):
                at = 0
                for word in line.split(" "):
                    if word:
                        out.append((page, order, word, at * self.CELL, row * self.ROW, len(word) * self.CELL, self.ROW))
                        order += 1
                    at += len(word) + 1
        return out

    def without(self, content: bytes, boxes: list[tuple[int, int, int, int, int]]) -> bytes:
        pages = [[list(line) for line in lines] for lines in self._pages(content)]
        for page, x, y, w, h in boxes:
            lines = pages[page] if 0 <= page < len(pages) else []
            for row in range(max(0, y // self.ROW), min(len(lines), -(-(y + h) // self.ROW))):
                for k in range(max(0, x // self.CELL), min(len(lines[row]), -(-(x + w) // self.CELL))):
                    lines[row][k] = "█"
        return "\f".join("\n".join("".join(line) for line in lines) for lines in pages).encode("utf-8")


def words(files: DataFrame, codec: Codec, first_page_only: bool = False) -> DataFrame:
    """doc_id, page, ord, text, x, y, w, h of the words of files(doc_id, content). A file that can't be read,
    and a null content, have no words; the files are read on the executors, one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    found = codec.words(bytes(content)) if content is not None else []
                except Exception:
                    found = []
                rows += [(doc, *w) for w in found if w[0] == 0 or not first_page_only]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ord", "text", "x", "y", "w", "h"])

    doc = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "content").mapInPandas(run, f"doc_id {doc}, page int, ord int, text string, x int, y int, w int, h int")


def rewritten(files: DataFrame, boxes: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, content, status of files(doc_id, content) without what boxes(doc_id, page, x, y, w, h) cover.

    status is "written", or "error" with a null content where a file can't be read: nothing unredacted
    leaves. A document's boxes travel to its file as one array.
    """
    own = boxes.groupBy("doc_id").agg(F.collect_list(F.struct("page", "x", "y", "w", "h")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, status = [], []
            for content, found in zip(pdf["content"], pdf["boxes"]):
                try:
                    places = [(b["page"], b["x"], b["y"], b["w"], b["h"]) for b in found] if found is not None else []
                    out.append(codec.without(bytes(content), places))
                    status.append("written")
                except Exception:
                    out.append(None)
                    status.append("error")
            yield pdf[["doc_id"]].assign(content=out, status=status)

    doc = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "content").join(own, "doc_id", "left").mapInPandas(run, f"doc_id {doc}, content binary, status string")


def to_write(files: DataFrame, boxes: DataFrame, kinds: DataFrame) -> DataFrame:
    """The files that are written: of kinds(doc_id, doc_type), structured PDF files without a box aren't,
    all others are."""
    idle = kinds.filter("doc_type = 'PDF_STRUCTURED'").select("doc_id").join(boxes.select("doc_id").distinct(), "doc_id", "left_anti")
    return files.join(idle, "doc_id", "left_anti")
