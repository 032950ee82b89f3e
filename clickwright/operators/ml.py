"""Spark ML feature transforms: indexing, one-hot, decoding, assembling, SQL and scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    Bucketizer, ElementwiseProduct, Interaction, MinMaxScaler, Normalizer, OneHotEncoder, SQLTransformer, StandardScaler, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickwright.operators.frequency_index import FrequencyIndex, FrequencyIndexModel

def string_index(df: DataFrame, col: str, out: str | None = None) -> tuple[DataFrame, FrequencyIndexModel]:
    """Frequency-ordered index (ties by text); unseen/null -> the number of labels.  The labels are a table, not a driver list."""
    model = FrequencyIndex(col, out).fit(df)
    return model.transform(df), model


def one_hot(df: DataFrame, index_cols: Sequence[str], drop_last: bool = True) -> DataFrame:
    enc = OneHotEncoder(inputCols=list(index_cols), outputCols=[f"{c}_OneHot" for c in index_cols], dropLast=drop_last,
                        handleInvalid="keep")
    return enc.fit(df).transform(df)


def index_to_string(df: DataFrame, index_col: str, out: str, model: FrequencyIndexModel) -> DataFrame:
    """The text behind each index, by a join with the model's table."""
    return model.decode(df, index_col, out)


def ml_pipeline(df: DataFrame, cols: Sequence[str], keep_index: bool = False) -> DataFrame:
    """Frequency index + OneHotEncoder per column in one ``Pipeline``; raw and (unless ``keep_index``) index columns dropped."""
    idx = [FrequencyIndex(c) for c in cols]
    oh = [OneHotEncoder(inputCols=[f"{c}Idx"], outputCols=[f"{c}Idx_OneHot"]) for c in cols]
    out = Pipeline(stages=idx + oh).fit(df).transform(df)
    return out.drop(*cols, *([] if keep_index else [f"{c}Idx" for c in cols]))


def assemble_vector(df: DataFrame, cols: Sequence[str], out: str = "feature") -> DataFrame:
    """One vector of numeric, boolean and vector columns."""
    plain = [c for c in cols if not isinstance(df.schema[c].dataType, VectorUDT)]
    cast = df.withColumns({c: F.col(c).cast("double") for c in plain})
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(cast)


def hot_position(df: DataFrame, index_col: str, hot_col: str) -> Column:
    """Where the 1 of a one-hot vector is, or -1 for the dropped category: from the index, without a dense vector."""
    size = df.schema[hot_col].metadata["ml_attr"]["num_attrs"]
    return F.when(F.col(index_col) < size, F.col(index_col)).otherwise(F.lit(-1)).cast("int")


def sql_transform(df: DataFrame, statement: str) -> DataFrame:
    """A ``SQLTransformer`` stage in a ``Pipeline``; the statement may call registered functions."""
    return Pipeline(stages=[SQLTransformer(statement=statement)]).fit(df).transform(df)


def bucketize(df: DataFrame, col: str, splits: Sequence[float], out: str) -> DataFrame:
    d = df.withColumn(col, F.col(col).cast("double"))
    return Bucketizer(splits=list(splits), inputCol=col, outputCol=out, handleInvalid="keep").transform(d)


def interact(df: DataFrame, cols: Sequence[str], out: str = "interaction") -> DataFrame:
    vec = assemble_vector(df, [cols[0]], "__v0")
    vec = assemble_vector(vec, list(cols[1:]), "__v1")
    return Interaction(inputCols=["__v0", "__v1"], outputCol=out).transform(vec).drop("__v0", "__v1")


def normalize(df: DataFrame, vec: str, out: str, p: float = 2.0) -> DataFrame:
    return Normalizer(inputCol=vec, outputCol=out, p=p).transform(df)


def standard_scale(df: DataFrame, vec: str, out: str, with_mean: bool = False, with_std: bool = True) -> DataFrame:
    return StandardScaler(inputCol=vec, outputCol=out, withMean=with_mean, withStd=with_std).fit(df).transform(df)


def minmax_scale(df: DataFrame, vec: str, out: str) -> DataFrame:
    return MinMaxScaler(inputCol=vec, outputCol=out).fit(df).transform(df)


def elementwise_product(df: DataFrame, vec: str, out: str, weights: Sequence[float]) -> DataFrame:
    return ElementwiseProduct(scalingVec=Vectors.dense(list(weights)), inputCol=vec, outputCol=out).transform(df)


def vector_columns(df: DataFrame, vec: str, names: Sequence[str], digits: int | None = None) -> DataFrame:
    """Unpack a vector column into double columns (optionally rounded half-even)."""
    arr = vector_to_array(vec)
    cols = {n: (F.bround(arr[i], digits) if digits is not None else arr[i]) for i, n in enumerate(names)}
    return df.withColumns(cols)
