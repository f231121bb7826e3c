"""Exact nearest neighbours for many queries at once.

Queries travel to the vectors in blocks of bounded size; every task keeps the best of its vectors for each query, and only those
are ranked together. No vector is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import COSINE, ascending, block_scores
from ..sources.views import View

#: Queries in one broadcast block, and vectors scored at once.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096


def _best(query_ids: list[int], queries, k: int, similarity: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = queries.value
        # the best so far, by query: its number, the node's id and the closeness
        at, ids, top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            for first in range(0, b.num_rows, VECTOR_BLOCK):
                part = b.slice(first, VECTOR_BLOCK)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                found = np.nan_to_num(block_scores(flat.reshape(part.num_rows, -1).astype(np.float64), wanted, similarity).T, nan=-np.inf)
                # all that reach the k-th closeness, ties too
                least = np.partition(found, -k, axis=1)[:, -k, None] if part.num_rows > k else -np.inf
                row, column = np.nonzero(found >= least)
                at, ids, top = np.concatenate([at, row]), np.concatenate([ids, part.column(0).to_numpy()[column]]), np.concatenate([top, found[row, column]])
                order = np.lexsort((ids, -top, at))
                at, ids, top = at[order], ids[order], top[order]
                kept = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, ids, top = at[kept], ids[kept], top[kept]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(query_ids, np.int64)[at]), pa.array(ids), pa.array(top)], ["query_id", "id", "closeness"])

    return run


def batch_nearest(view: View, prop: str, queries: Iterable[tuple[int, Sequence[float]]], k: int, similarity: str = COSINE) -> DataFrame:
    """(query_id, id, score, rank) of each query's k nearest nodes; ties go to the lower id.

    Of an iterator of queries only one block is held at a time.
    """
    spark = view.df.sparkSession
    vector = view.vector(prop)
    parts = []
    for block in batched(queries, QUERY_BLOCK):
        if not parts:
            rows = view.df.filter(vector.isNotNull() & (F.size(vector) == len(block[0][1]))).select("id", vector.alias("v"))
        matrix = spark.sparkContext.broadcast(np.array([q for _, q in block], np.float32).astype(np.float64))
        parts.append(rows.mapInArrow(_best([i for i, _ in block], matrix, k, similarity), "query_id bigint, id bigint, closeness double"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    found = reduce(DataFrame.unionByName, parts)
    order = W.partitionBy("query_id").orderBy(F.desc("closeness"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    number = -F.col("closeness") if ascending(similarity) else F.col("closeness")
    return ranked.select("query_id", "id", number.alias("score"), "rank")
