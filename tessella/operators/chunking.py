"""Entities, their relations and feature vectors of texts, over Arrow batches."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ENTITY = {
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "url": r"https?://[^\s<>\"']+",
    "code": r"`[^`\n]+`|\b[a-z]+(?:_[a-z0-9]+)+\b|\b\w+\(\)",
    "name": r"\b[A-ZÄÖÜÉ][a-zäöüßéèêáíóúñ]+(?: [A-ZÄÖÜÉ][a-zäöüßéèêáíóúñ]+)+\b",
}


def entities_of(text: str) -> list[tuple[str, str, int]]:
    """Entities by pattern, earlier kinds first; overlapping later ones drop out."""
    taken: list[tuple[int, int]] = []
    out = []
    for kind, pattern in ENTITY.items():
        for m in re.finditer(pattern, text):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
                out.append((kind, m.group(0).strip("`"), m.start()))
    return sorted(out, key=lambda x: x[2])


def regex_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, n, a) for i, t in zip(frame[id_col], frame[text_col].fillna(""), strict=True) for k, n, a in entities_of(t)]
            yield pd.DataFrame(rows, columns=[id_col, "etype", "name", "at"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, etype string, name string, at int")


def proximity_relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: int = 60) -> DataFrame:
    """Pairs of entities at most ``within`` characters apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, t in zip(frame[id_col], frame[text_col].fillna(""), strict=True):
                found = entities_of(t)
                for k, (_, a, x) in enumerate(found):
                    for _, b, y in found[k + 1 :]:
                        if y - x > within:
                            break
                        if a != b:
                            rows.append((i, min(a, b), max(a, b), y - x))
            yield pd.DataFrame(rows, columns=[id_col, "a", "b", "distance"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, a string, b string, distance int")


def hash_embedding(text: str, dim: int = 256) -> np.ndarray:
    """Signed feature hashing of words and character trigrams, of length 1."""
    v = np.zeros(dim)
    low = text.lower()
    for feature in (*re.findall(r"\w+", low), *(f"#{low[i : i + 3]}" for i in range(min(len(low), 512) - 2))):
        h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(float(v @ v))
    return v / n if n else v


def embed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = 256) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({id_col: frame[id_col], "embedding": [hash_embedding(t or "", dim).astype("float32") for t in frame[text_col]]})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, embedding array<float>")
