"""Nearest-neighbour self-join on vectors (squared L2), the one-hop representative rule, and a vector index on disk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cells


def _source(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), df[vec_col].alias("v")).where("v is not null")


def nearest(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = 1 << 20, max_pivots: int = cells.MAX_PIVOTS) -> DataFrame:
    """id, nid, d, rank of the k nearest rows of each row (itself included), exact, ties by nid.

    Ids of any sortable type; rows without a vector have no neighbours and are none. See cells
    for the plan: vectors are sent once as queries and at most once a group of queries as data.
    """
    src = _source(df, id_col, vec_col)
    pivots = cells.choose_pivots(src, max_pivots)
    packed = cells.blocks(src, pivots, block_bytes)
    return cells.search(packed, packed, pivots, k)[0]


def near_duplicates(df: DataFrame, threshold: float = 0.05, k: int = 500, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: id, min_neighbor_distance, repeat_count, representative (the least near row's id if it stands before the row, else its own; null without neighbours). One hop, not transitive. Each row is summed up in its task; only rows nearer than the threshold, and the nearest one, are searched for."""
    src = _source(df, id_col, vec_col)
    kind = dict(src.dtypes)["id"]

    def fold(rows: pd.DataFrame, ids: pd.Series) -> pd.DataFrame:
        other = rows[rows.nid.to_numpy() != rows.id.to_numpy()]
        near = other[other.d < threshold]
        by = near.groupby("id").nid
        out = pd.DataFrame({id_col: ids.to_numpy()})
        out["min_neighbor_distance"] = out[id_col].map(other.groupby("id").d.min())
        out["repeat_count"] = out[id_col].map(by.size()).fillna(0).astype(np.int64)
        first = out[id_col].map(by.min())
        least = [None if pd.isna(f) else min(f, i) for f, i in zip(first, out[id_col], strict=True)]
        out["representative"] = pd.array(least, dtype="Int64") if pd.api.types.is_integer_dtype(ids) else least
        return out

    pivots = cells.choose_pivots(src)
    packed = cells.blocks(src, pivots)
    return cells.search(packed, packed, pivots, k, threshold, fold, f"`{id_col}` {kind}, min_neighbor_distance double, repeat_count long, representative {kind}")[0]


def near_duplicate_rows(df: DataFrame, threshold: float = 0.05, k: int = 500, position: str = "row_idx", id_col: str = "conversation_id", vec_col: str = "embedding") -> DataFrame:
    """df, all its rows and columns, with min_neighbor_distance, repeat_count and min_similar_conversation_id: the id at the representative's position, null without neighbours."""
    found = near_duplicates(df, threshold, k, position, vec_col)
    named = df.select(F.col(position).alias("representative"), F.col(id_col).alias("min_similar_conversation_id"))
    found = found.join(named, "representative", "left").select(position, "min_neighbor_distance", "repeat_count", "min_similar_conversation_id")
    return df.join(found, position, "left")


def deduplicated(df: DataFrame, id_col: str = "conversation_id", near: str = "min_similar_conversation_id") -> DataFrame:
    """Rows that represent themselves or have no neighbours."""
    return df.where(F.col(near).isNull() | (F.col(near) == F.col(id_col)))


def _write_cells(src: DataFrame, pivots: np.ndarray, path: str, mode: str) -> None:
    packed = cells.blocks(src, pivots)
    files = packed.repartition(F.col("cell"), F.pmod(F.xxhash64("ids"), F.lit(8)))
    files.write.mode(mode).partitionBy("cell").parquet(f"{path}/cells")


def save_index(df: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", max_pivots: int = cells.MAX_PIVOTS) -> None:
    """An inverted index in place of what is at path: the centres, and a folder a cell with packed vectors, each pack with its size and radii."""
    src = _source(df, id_col, vec_col)
    pivots = cells.choose_pivots(src, max_pivots)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(pivots)]
    df.sparkSession.createDataFrame(rows, "cell int, centre array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _write_cells(src, pivots, path, "overwrite")


def append_index(df: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """More vectors into the cells of an index; its centres stay."""
    _write_cells(_source(df, id_col, vec_col), _centres(df.sparkSession, path), path, "append")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # cells.MAX_PIVOTS at most
    return np.array([r.centre for r in rows], np.float32)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """vec_id and embedding of all vectors of an index."""
    stored = spark.read.parquet(f"{path}/cells")
    kind = dict(stored.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def opened(parts):
        for b in parts:
            for ids, body in zip(b.ids, b.vectors, strict=True):
                yield pd.DataFrame({"vec_id": list(ids), "embedding": list(np.frombuffer(body, np.float32).reshape(len(ids), -1))})

    return stored.select("ids", "vectors").mapInPandas(opened, f"vec_id {kind}, embedding array<float>")


def search_index(queries: DataFrame, path: str, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, nid, d, rank of the k nearest stored vectors of each query row, exact. Only folders of cells that can hold a neighbour are read; for few queries those are few."""
    spark = queries.sparkSession
    pivots = _centres(spark, path)
    # Sizes and radii come from the packs themselves, so an append that failed half-way or is still going on can't make them wrong.
    asked = cells.blocks(_source(queries, id_col, vec_col), pivots)
    stored = spark.read.parquet(f"{path}/cells")
    return cells.search(asked, stored, pivots, k)[0]
