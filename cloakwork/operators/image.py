"""Solid fills on raw picture buffers, and picture files without their metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def plain_file(content: bytes) -> bytes:
    """A JPEG file without its APP1 to APP15 and comment segments, a PNG file without text, time and EXIF
    chunks; other content raises."""
    if content[:2] == b"\xff\xd8":
        out, at = [content[:2]], 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
            end = at + 2 + int.from_bytes(content[at + 2 : at + 4], "big")
            if not (0xE1 <= content[at + 1] <= 0xEF or content[at + 1] == 0xFE):
                out.append(content[at:end])
            at = end
        return b"".join(out) + content[at:]
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        out, at = [content[:8]], 8
        while at + 8 <= len(content):
            end = at + 12 + int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] not in (b"tEXt", b"zTXt", b"iTXt", b"tIME", b"eXIf"):
                out.append(content[at:end])
            at = end
        return b"".join(out)
    raise ValueError("neither JPEG nor PNG")


def without_metadata(files: DataFrame) -> DataFrame:
    """doc_id, content, removed of files(doc_id, content): bytes of metadata removed, null with a null
    content where the file is neither JPEG nor PNG."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, removed = [], []
            for content in pdf["content"]:
                try:
                    plain = plain_file(bytes(content))
                except Exception:
                    plain = None
                out.append(plain)
                removed.append(None if plain is None else len(content) - len(plain))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": out, "removed": pd.array(removed, dtype="Int64")})

    doc = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "content").mapInPandas(run, f"doc_id {doc}, content binary, removed long")


def filled(images: DataFrame, fill: tuple[int, ...] = (0, 0, 0)) -> DataFrame:
    """images(image_id, height, width, channels, data, boxes) with every box filled, without boxes.

    data holds height x width x channels bytes; boxes is array<struct<x, y, w, h>>, null for none. Boxes
    are clamped to the picture, empty ones do nothing, pixels outside stay as they are. A buffer whose
    length doesn't fit its sizes raises.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for height, width, channels, data, boxes in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"], pdf["boxes"]):
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).copy()
                colour = np.array([fill[k % len(fill)] for k in range(channels)], dtype=np.uint8)
                for b in boxes if boxes is not None else ():
                    x1, y1, x2, y2 = max(0, b["x"]), max(0, b["y"]), min(width, b["x"] + b["w"]), min(height, b["y"] + b["h"])
                    if x2 > x1 and y2 > y1:
                        pixels[y1:y2, x1:x2] = colour
                out.append(pixels.tobytes())
            yield pdf[["image_id", "height", "width", "channels"]].assign(data=out)

    return images.select("image_id", "height", "width", "channels", "data", "boxes").mapInPandas(run, "image_id string, height int, width int, channels int, data binary")
