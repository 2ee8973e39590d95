"""Word vectors in text form, subword tokenising, and image measures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import similarity


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) from lines ``word x1 x2 ...``; a header of two numbers is
    left out."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(F.size(parts) > 2)
    return rows.select(F.get(parts, F.lit(0)).alias("word"), F.transform(F.filter(F.slice(parts, 2, F.size(parts)), lambda x: x != ""), lambda x: x.cast("double")).alias("vector"))


def most_similar(vectors: DataFrame, word: str, k: int = 10) -> DataFrame:
    """The k words of the highest cosine, the word itself left out."""
    own = vectors.where(F.col("word") == word).first()
    if own is None:
        return vectors.limit(0).withColumn("score", F.lit(0.0))
    score = similarity(F.col("vector"), F.array(*[F.lit(float(x)) for x in own["vector"]]))
    return vectors.where(F.col("word") != word).select("word", score.alias("score")).orderBy(F.desc("score"), "word").limit(k)


class SubwordCodec:
    """Byte-pair merges over words that end in ``</w>``."""

    def __init__(self, merges: Sequence[tuple[str, str]], vocabulary: dict[str, int]):
        self.rank = {m: k for k, m in enumerate(merges)}
        self.vocabulary, self.names = vocabulary, {v: k for k, v in vocabulary.items()}
        self.memo: dict[str, list[str]] = {}

    def pieces(self, word: str) -> list[str]:
        if word not in self.memo:
            parts = [*word[:-1], word[-1] + "</w>"]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
                if (parts[best], parts[best + 1]) not in self.rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.memo[word] = parts
        return self.memo[word]

    def encode(self, text: str, unknown: int = 0) -> list[int]:
        return [self.vocabulary.get(p, unknown) for w in text.split() for p in self.pieces(w)]

    def decode(self, ids: Sequence[int]) -> str:
        return "".join(self.names.get(i, "") for i in ids).replace("</w>", " ").strip()

    def column(self, text: Column) -> Column:
        @F.pandas_udf("array<int>")
        def run(column: pd.Series) -> pd.Series:
            return column.map(lambda t: self.encode(t or ""))

        return run(text)


# ---- images as structs of channels x height x width -----------------------------------------


def channel_means(data: Column, channels: int, size: Column) -> Column:
    """Mean of each channel of a planar array."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.aggregate(F.slice(data, c * size + 1, size), F.lit(0.0), lambda s, v: s + v) / size)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes struct<x,y,width,height>."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    either = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when(either > 0, both / either).otherwise(0.0)


def dice(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap of two masks; 1 if both are empty."""
    a, b = np.asarray(a, bool), np.asarray(b, bool)
    return float(2 * (a & b).sum() / (a.sum() + b.sum())) if a.any() or b.any() else 1.0


def non_maximum_suppression(df: DataFrame, image: str, least_iou: float = 0.5) -> DataFrame:
    """(image, x, y, width, height, score, label): per image and label, boxes in
    the order of scores; those that overlap a kept one are dropped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", ascending=False, kind="stable")
        x, kept = pdf[["x", "y", "width", "height"]].to_numpy(float), []
        for i in range(len(x)):
            for j in kept:
                w = min(x[i, 0] + x[i, 2], x[j, 0] + x[j, 2]) - max(x[i, 0], x[j, 0])
                h = min(x[i, 1] + x[i, 3], x[j, 1] + x[j, 3]) - max(x[i, 1], x[j, 1])
                both = max(w, 0) * max(h, 0)
                if both > least_iou * (x[i, 2] * x[i, 3] + x[j, 2] * x[j, 3] - both):
                    break
            else:
                kept.append(i)
        return pdf.iloc[kept]

    return df.groupBy(image, "label").applyInPandas(run, df.schema)
