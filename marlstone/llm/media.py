"""Media columns: payloads stored as progressive JPEG and read back as bytes, RGB tensors and features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.jpeg import BLOCK_BYTES, Image, encode
from marlstone.llm.session import map_texts


#: Images decoded at once.
AT_ONCE = 200


def padded(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK_BYTES if data else BLOCK_BYTES)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) per row of ``docs``: its text's UTF-8 bytes, padded, as a progressive JPEG.

    A null text counts as empty and is stored as 64 zero bytes. Null or equal ids keep their rows; an empty table gives
    an empty result; other columns are not read. A text may have up to some 6 GB.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [t.encode() for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(x) for x in raw], "media": [encode(padded(x)) for x in raw]})

    return map_texts(docs, run, "doc_id long, n_bytes long, media binary", id_col, text_col)


def tensors(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload, height, width, rgb, feature) per row of ``stored``: the bytes read back from the
    image's coefficients, its full-resolution RGB tensor, uint8 in row-major order, and the tensor's feature.

    Null or equal ids keep their rows; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), AT_ONCE):
                some, rows = b.iloc[at : at + AT_ONCE], []
                for media in some["media"]:
                    image = Image(media)
                    rgb = b"".join([strip.tobytes() for strip in image.rgb_strips()])
                    rows.append((image.payload(), image.height, image.width, rgb, feature(image.height, image.width, rgb)))
                yield some.assign(**dict(zip(("payload", "height", "width", "rgb", "feature"), map(list, zip(*rows, strict=True)), strict=True)))

    return stored.select("doc_id", "n_bytes", "media").mapInPandas(
        run, "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary, feature string"
    )


def feature(height: int, width: int, rgb: bytes) -> str:
    """Size, mean of each channel and mean absolute step to the right, in thousandths, over the whole RGB tensor."""
    pixels = np.frombuffer(rgb, dtype=np.uint8).reshape(height, width, 3)
    n, steps, sums = height * width, 0, np.zeros(3, dtype=np.int64)
    for top in range(0, height, 1024):
        strip = pixels[top : top + 1024]
        sums += strip.sum(axis=(0, 1), dtype=np.int64)
        green = strip[..., 1].astype(np.int16)
        steps += int(np.abs(green[:, 1:] - green[:, :-1]).sum(dtype=np.int64))
    means = [int(s) * 1000 // n for s in sums]
    return f"{width}x{height};rgb={means[0]},{means[1]},{means[2]};step={steps * 1000 // n}"


def digests(read: DataFrame) -> DataFrame:
    """What the columns of ``tensors`` hold: payload_bytes, payload_sha256, tail_crc32 (of its last 64 bytes), media_bytes,
    media_sha256 and the feature of the RGB tensor, per row of ``read``. Null or equal ids keep their rows."""
    size = lambda c: F.octet_length(c).cast("long")
    return read.select(
        "doc_id", "n_bytes", size("payload").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), size("media").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
