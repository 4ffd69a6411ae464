"""BPE encoding and decoding of whole texts by per-prefix dynamic programming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from marlstone.llm.bpe import prefix_encoder, vocabulary
from marlstone.llm.session import map_texts
from marlstone.llm.units import UnitCache, pack


class Codec:
    """Encodes and decodes with a byte-level vocabulary; special strings in texts become their ids."""

    def __init__(self, path: str):
        encoder = prefix_encoder(path)
        words = vocabulary(path)
        self.special = words.special
        self.cache = UnitCache(lambda ws: [pack(encoder.encode(w.encode())) for w in ws], words.special)
        top = max([*words.bytes, *words.special.values()]) + 1
        self.text_of: list[bytes] = [b""] * top
        for i, b in words.bytes.items():
            self.text_of[i] = b
        for s, i in words.special.items():
            self.text_of[i] = s.encode()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.cache.ids(text)

    def decode(self, ids: bytes) -> str:
        texts = self.text_of
        return b"".join([texts[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary, little-endian unsigned 32-bit) and the text decoded from them.

    No shuffle: each row is encoded where it is read. A null text counts as empty and has no ids; ids that are null or
    repeat are kept as they are; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary_path)
        for b in batches:
            ids = list(c.cache.ids_of(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids, "decoded": [c.decode(i) for i in ids]})

    return map_texts(docs, run, "doc_id long, ids binary, decoded string", id_col, text_col)


def encode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, but only n_tokens and the SHA-256 of ids and decoded text leave the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary_path)
        for b in batches:
            rows = []
            for ids in c.cache.ids_of(b["text"]):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return map_texts(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)
