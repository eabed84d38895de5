"""Exact vector search for batches of questions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import norm
from .keyword import top

#: Questions in one pass over the rows, and in one matrix product.
PASS, BATCH = 32_768, 1_024


def top_k(rows: DataFrame, key: str, vector: str, questions: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
    """The ``k`` rows nearest to each question, with ``rank``.

    Each task keeps its own best ``k`` for each question from matrix products
    over Arrow batches; only those reach the ranking. ``PASS`` questions go out
    with each scan of the rows, and the driver holds no more of them at once.
    """
    kind, out = rows.schema[key].dataType, None
    asked = questions.select(query_id, query_vector).where(F.col(query_vector).isNotNull()).toLocalIterator()
    while (batch := [(r[0], r[1]) for r in islice(asked, PASS)]) or out is None:
        found = _nearest(rows, key, vector, batch, questions.schema[query_id].dataType, kind, k)
        out = found if out is None else out.unionByName(found)
    return top(out, k)


def top_pairs(rows: DataFrame, key: str, vector: str, questions: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
    """The best ``k`` of all pairs of each question, as SQL ranks them: ``top_k`` with the rows that have no cosine (no vector, or a zero one) last, by key.

    Rows are dealt to all cores first, for a file of one row group is one task
    and the work grows with rows times questions.
    """
    known = lambda df, x: F.coalesce(norm(df[x]) > 0, F.lit(False))
    cores = 3 * rows.sparkSession.sparkContext.defaultParallelism
    found = top_k(rows.where(known(rows, vector)).select(key, vector).repartition(cores), key, vector, questions.where(known(questions, query_vector)), query_id, query_vector, k)
    found = found.select("query_id", "key", "score")
    for side, of in ((rows.where(~known(rows, vector)), known(questions, query_vector)), (rows, ~known(questions, query_vector))):
        last = side.select(F.col(key).alias("key")).orderBy("key").limit(k)
        found = found.unionByName(questions.where(of).select(F.col(query_id).alias("query_id")).join(F.broadcast(last)).withColumn("score", F.lit(None).cast("double")))
    return top(found, k)


def _nearest(rows: DataFrame, key: str, vector: str, asked: list, query_kind, kind, k: int) -> DataFrame:
    ids = [a[0] for a in asked]
    matrix = np.array([a[1] for a in asked], np.float64).reshape(len(asked), -1)
    with np.errstate(all="ignore"):
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    id_type = to_arrow_type(query_kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(1)))
            if not batch.num_rows or not ids:
                continue
            lists = batch.column(1)
            v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            with np.errstate(all="ignore"):
                v /= np.linalg.norm(v, axis=1, keepdims=True)
            n = min(k, len(v))
            for start in range(0, len(ids), BATCH):
                with np.errstate(all="ignore"):
                    scores = v @ matrix[start : start + BATCH].T
                ranked = np.where(np.isnan(scores), -np.inf, np.round(scores, 9))
                bar = -np.partition(-ranked, n - 1, axis=0)[n - 1]  # ties at the bar all go on
                row, query = np.nonzero(ranked >= bar)
                score = scores[row, query]
                named = pa.array([ids[start + q] for q in query.tolist()], id_type)
                yield pa.RecordBatch.from_arrays([named, batch.column(0).take(pa.array(row)), pa.array(score, mask=np.isnan(score))], names=["query_id", "key", "score"])

    schema = f"query_id {query_kind.simpleString()}, key {kind.simpleString()}, score double"
    return rows.select(key, vector).mapInArrow(run, schema)
