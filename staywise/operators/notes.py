"""Text branch: encoding notes and reducing the vectors.

An encoder is a function ``list[str] -> list of vectors``. It is built inside each
Python worker, once, from a factory; the model itself never travels with the task.
Without a factory, notes are hashed into token counts weighted by rarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise import fixed_values as fv
from staywise.functions.plugins import built_once, factory_key
from staywise.functions.text import text_or_empty
from staywise.functions.vectors import as_vector, zero_array
from staywise.session import ship_code, written

EncoderFactory = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]


class EncoderUnavailable(RuntimeError):
    """The plugged-in encoder failed while fitting; only scoring goes on without it."""


def encoder_column(factory: EncoderFactory, width: int) -> Callable[[Column], Column]:
    """A column function ``text -> struct<vector, available>``.

    A failing encoder does not fail the job: the rows of that Arrow batch get zero
    vectors and ``available = false``. An encoder may also decline single texts by
    returning None for them.
    """
    ship_code()
    key = factory_key(factory)

    @F.pandas_udf("vector array<double>, available boolean")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            try:
                found = list(built_once(factory, key)(texts.fillna("").tolist()))
                available = np.array([v is not None for v in found], dtype=bool)
                vectors = np.asarray([np.zeros(width) if v is None else v for v in found], dtype=float).reshape(len(found), -1)
                if vectors.shape != (len(texts), width):
                    raise ValueError(f"expected {len(texts)} vectors of width {width}, got {vectors.shape}")
            except Exception:
                vectors, available = np.zeros((len(texts), width)), np.zeros(len(texts), dtype=bool)
            yield pd.DataFrame({"vector": list(vectors), "available": available})

    return encode


def tokens(c: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores in any script."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), "")


def default_encoder(width: int = fv.EMBEDDING_WIDTH, words: str = "_tokens", output: str = "_encoded") -> Pipeline:
    """Token hashing with inverse document frequency, unit length."""
    return Pipeline(
        stages=[
            HashingTF(inputCol=words, outputCol="_counts", numFeatures=width),
            IDF(inputCol="_counts", outputCol="_weighted"),
            Normalizer(inputCol="_weighted", outputCol=output),
        ]
    )


class TextTransform:
    """A fitted encoder and a centred, sign-fixed principal component projection."""

    def __init__(
        self,
        pca: PCAModel,
        mean: list[float],
        encoder: PipelineModel | None = None,
        factory: EncoderFactory | None = None,
        width: int = fv.EMBEDDING_WIDTH,
    ) -> None:
        self.pca = pca
        self.mean = mean
        self.encoder = encoder
        self.factory = factory
        self.width = width
        loadings = np.asarray(pca.pc.toArray())
        strongest = np.abs(loadings).argmax(axis=0)
        self.signs = np.where(loadings[strongest, np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
        self.offset = np.asarray(mean) @ loadings

    @property
    def components(self) -> int:
        return len(self.signs)

    def names(self) -> list[str]:
        return [f"nlp__pca{i}" for i in range(self.components)]

    def save(self, spark: SparkSession, path: str) -> None:
        """Component model, mean and, if there is one, the fitted encoder."""
        self.pca.write().overwrite().save(f"{path}/pca")
        row = spark.createDataFrame([(self.width, self.mean, self.encoder is not None)], "width int, mean array<double>, fitted boolean")
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/mean")
        if self.encoder is not None:
            self.encoder.write().overwrite().save(f"{path}/encoder")

    @staticmethod
    def load(spark: SparkSession, path: str, factory: EncoderFactory | None = None) -> TextTransform:
        """An encoder that was plugged in is plugged in again: it is not part of the artifact."""
        row = spark.read.parquet(f"{path}/mean").first()
        encoder = PipelineModel.load(f"{path}/encoder") if row["fitted"] else None
        return TextTransform(PCAModel.load(f"{path}/pca"), list(row["mean"]), encoder, factory, row["width"])

    def reduce(self, df: DataFrame, vector: str, output: str) -> DataFrame:
        """Project an ML vector column; Spark's projection does not centre, so the offset is taken off."""
        projected = self.pca.setInputCol(vector).setOutputCol("_projected").transform(df)
        offset = F.array(*[F.lit(float(o)) for o in self.offset])
        signs = F.array(*[F.lit(float(s)) for s in self.signs])
        centred = F.zip_with(vector_to_array("_projected"), offset, lambda a, b: a - b)
        return projected.withColumn(output, F.zip_with(centred, signs, lambda a, s: a * s)).drop("_projected")

    def apply(self, df: DataFrame, note: str = fv.NOTE, output: str = "nlp_vector") -> DataFrame:
        """Add ``output array<double>`` and ``nlp_available``."""
        encoded, helpers = encode_notes(df, note, self.encoder, self.factory, self.width)
        reduced = self.reduce(encoded, "_encoded", "_reduced")
        # An unavailable encoder scores the zero vector itself, not the projection of one.
        value = F.when(F.col("nlp_available"), F.col("_reduced")).otherwise(zero_array(self.components))
        return reduced.withColumn(output, value).drop("_reduced", "_encoded", *helpers)


def encode_notes(
    df: DataFrame, note: str, encoder: PipelineModel | None, factory: EncoderFactory | None, width: int
) -> tuple[DataFrame, list[str]]:
    """Add ``_encoded`` (ML vector) and ``nlp_available``; also the helper columns to drop."""
    texts = df.withColumn("_text", text_or_empty(F.col(f"`{note}`")))
    if factory is not None:
        encoded = texts.withColumn("_reply", encoder_column(factory, width)(F.col("_text")))
        encoded = encoded.withColumn("_encoded", as_vector(F.col("_reply.vector")))
        return encoded.withColumn("nlp_available", F.col("_reply.available")), ["_text", "_reply"]
    worded = texts.withColumn("_tokens", tokens(F.col("_text")))
    encoded = encoder.transform(worded).withColumn("nlp_available", F.lit(True))
    return encoded, ["_text", "_tokens", "_counts", "_weighted"]


def fit_pca(vectors: DataFrame, column: str, components: int) -> tuple[PCAModel, list[float]]:
    """Principal components and the column mean of an ML vector column."""
    mean = vectors.select(Summarizer.mean(F.col(column))).first()[0]
    model = PCA(k=components, inputCol=column, outputCol="_projected").fit(vectors.select(column))
    return model, [float(m) for m in mean.toArray()]


def fit_notes(
    train: DataFrame,
    note: str = fv.NOTE,
    components: int = fv.TEXT_COMPONENTS,
    width: int = fv.EMBEDDING_WIDTH,
    factory: EncoderFactory | None = None,
) -> TextTransform:
    texts = train.select(text_or_empty(F.col(f"`{note}`")).alias(note))
    encoder = None
    if factory is None:
        encoder = default_encoder(width).fit(texts.select(tokens(F.col(f"`{note}`")).alias("_tokens")))
    encoded, _ = encode_notes(texts, note, encoder, factory, width)
    # The component fit passes over the vectors several times; the texts are encoded once.
    vectors = written(encoded.select("_encoded", "nlp_available"), "vectors")
    if factory is not None:
        failed = vectors.where(~F.col("nlp_available")).count()
        if failed:
            raise EncoderUnavailable(f"the encoder failed on {failed} notes; nothing is fitted on stand-in vectors")
    pca, mean = fit_pca(vectors, "_encoded", components)
    return TextTransform(pca, mean, encoder, factory, width)
