"""Edited-nearest-neighbour under-sampling over an exact, partitioned neighbour search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.functions.prefix import rank_values
from vitalspan.ml.neighbours import BLOCK_ROWS, nearest_outside, nearest_rows
from vitalspan.session import cut_lineage

if TYPE_CHECKING:
    from vitalspan.ml.margins import Kernel
    from vitalspan.ml.shared import Encoded


def edited_rows(points: DataFrame, k: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Row ids kept: the whole smallest class, and rows whose ``k`` nearest all share their class."""
    sizes = points.groupBy("label").count().collect()  # one row per class
    if not sizes:
        return points.select("row_id")
    smallest = min(sizes, key=lambda r: (r["count"], -r["label"]))["label"]
    agree = F.forall("near", lambda n: n["label"] == F.col("label"))
    edited = nearest_rows(points, k, block_rows, skip=smallest).where(agree)
    return points.where(F.col("label") == F.lit(smallest)).select("row_id").unionByName(edited.select("row_id"))


#: Squared distances of folds searched together differ by no more than this part.
ALIKE = 0.5


@dataclass
class EditedNearestNeighbours:
    """A sampler of training rows: the smallest class, and rows whose ``k`` nearest all share their class."""

    key: str
    label: str
    k: int
    block_rows: int

    def __call__(self, encoded: DataFrame, features: str) -> DataFrame:
        """The rows kept of one fit's encoded training rows."""
        key, label = self.key, self.label
        if not isinstance(encoded.schema[key].dataType, T.IntegralType):
            ranks = cut_lineage(rank_values(encoded.select(key), key, descending=False).select(key, F.col("rank").alias("__rank")))
            kept = replace(self, key="__rank")(encoded.join(ranks, key), features)
            return kept.drop("__rank")
        points = encoded.select(
            F.col(key).cast("long").alias("row_id"),
            F.col(label).cast("double").alias("label"),
            vector_to_array(features).alias("vector"),
        )
        kept = edited_rows(points, self.k, self.block_rows).select(F.col("row_id").alias(key))
        return cut_lineage(encoded.join(kept, key, "left_semi"))

    def by_fold(self, encoded: Encoded, kernels: Sequence[Kernel]) -> DataFrame:
        """The rows with ``kept``: for each kernel, whether its sampling would keep the row.

        Kernels of the same features are searched together where their metrics are alike; each
        keeps what a search by itself would keep. What ``kept`` says of a kernel's left-out rows
        has no meaning.
        """
        rows = encoded.frame
        if isinstance(rows.schema["row_id"].dataType, T.IntegralType):
            marked = rows.withColumn("__id", F.col("row_id").cast("long"))
        else:
            ranks = rank_values(rows.select("row_id"), "row_id", descending=False)
            marked = cut_lineage(rows.join(ranks.select("row_id", F.col("rank").alias("__id")), "row_id"))
        sizes = marked.groupBy("fold", "label").count().collect()  # folds x classes
        smallest = []
        for kernel in kernels:
            held: dict[float, int] = {}
            for r in sizes:
                if r["fold"] != kernel.without:
                    held[r["label"]] = held.get(r["label"], 0) + r["count"]
            smallest.append(min(held, key=lambda y: (held[y], -y), default=None))
        edited = []
        for places, scales, ratios in searches(kernels, len(encoded.names)):
            used = np.flatnonzero(scales)
            vector = F.array(*[F.get("features", F.lit(int(j))) * F.lit(float(scales[j])) for j in used]).cast("array<double>")
            points = marked.select(F.col("__id").alias("row_id"), "label", "fold", vector.alias("vector"))
            skip = {smallest[p] for p in places}
            folds = [kernels[p].without for p in places]
            found = nearest_outside(points, folds, ratios[:, used], self.k, self.block_rows, skip.pop() if len(skip) == 1 else None)
            place = F.create_map(*[F.lit(int(v)) for pair in zip(folds, places) for v in pair])
            agree = found.where(F.forall("near", lambda n: n["label"] == F.col("label")))
            edited.append(agree.select(F.col("row_id").alias("__id"), place[F.col("without")].alias("place")))
        if not edited:
            return rows.withColumn("kept", F.array().cast("array<boolean>"))
        where = reduce(DataFrame.unionByName, edited).groupBy("__id").agg(F.collect_list("place").alias("places"))
        own = [
            F.coalesce(F.array_contains("places", F.lit(p)), F.lit(False)) | (F.col("label") == F.lit(least) if least is not None else F.lit(False))
            for p, least in enumerate(smallest)
        ]
        joined = marked.join(where, "__id", "left").withColumn("kept", F.array(*own))
        return cut_lineage(joined.select(*rows.columns, "kept"))


def searches(kernels: Sequence[Kernel], size: int) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places, scales, ratios) of kernels that one search serves: same features, metrics alike.

    Features times their scales span the search; ``ratios`` are what each kernel's squared
    differences are of the search's. A level that a kernel's training rows lack makes no difference.
    """
    weights = np.zeros((len(kernels), size))
    free = np.zeros((len(kernels), size), bool)
    for k, kernel in enumerate(kernels):
        weights[k, kernel.used] = 1.0 / kernel.deviation**2
        free[k, kernel.lacking] = True
    left, out = list(range(len(kernels))), []
    while left:
        places, most = [], np.zeros(size)
        for k in left:
            if places and kernels[k].spec != kernels[places[0]].spec:
                continue
            new = np.maximum(most, weights[k])
            if all(((weights[p] >= ALIKE * new) | free[p]).all() for p in [*places, k]):
                places, most = [*places, k], new
        left = [k for k in left if k not in places]
        ratios = np.where(free[places] | (most == 0), 1.0, weights[places] / np.where(most == 0, 1.0, most))
        out.append((places, np.sqrt(most), ratios))
    return out


def edited_nearest_neighbours(key: str = "row_id", label: str = "label", k: int = 3, block_rows: int = BLOCK_ROWS) -> EditedNearestNeighbours:
    """A sampler for the training rows of a fit: (encoded rows, vector column) -> rows kept.

    Keys are unique; those that are no whole numbers are searched by their rank. Shared fits
    (``margins.cross_margins``) have it sample all their folds at once.
    """
    return EditedNearestNeighbours(key, label, k, block_rows)
