"""Registry of extractors: named plug-ins that turn a frame of rasters into a frame of results.

No models are bundled. A plug-in gives a factory, called once per Python worker, whose product takes and
returns pandas frames; unavailable ones stay listed with their reason, as a dimension that queries can join.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Extractor:
    name: str
    schema: str
    factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    needs_template: bool = False
    available: bool = True
    reason: str = ""


class Registry:
    """Order of registration is data: it breaks ties in rankings."""

    def __init__(self):
        self._all: dict[str, Extractor] = {}

    def add(self, extractor: Extractor) -> Extractor:
        if extractor.name in self._all:
            raise ValueError(f"extractor {extractor.name} is registered already")
        self._all[extractor.name] = extractor
        return extractor

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, e.name, e.needs_template, e.available, e.reason) for i, e in enumerate(self._all.values())]
        return spark.createDataFrame(rows, "ord int, name string, needs_template boolean, available boolean, reason string")

    def run(self, name: str, frame: DataFrame) -> DataFrame:
        """One pass over the frame in batches; gives the plug-in's columns, ``elapsed_ms`` a row, and ``error``.

        A batch that raises is taken row by row; a row that raises gives its error and null results, and the run goes on.
        """
        extractor = self._all[name]
        if not extractor.available:
            raise RuntimeError(f"{name}: {extractor.reason}")
        names = [c.split()[0] for c in extractor.schema.split(", ")]
        made: list = []

        def one(batch: pd.DataFrame) -> pd.DataFrame:
            began = time.perf_counter()
            out = made[0](batch).reindex(columns=names).assign(error=None)
            return out.assign(elapsed_ms=(time.perf_counter() - began) * 1000 / max(1, len(batch)))

        def row(batch: pd.DataFrame) -> pd.DataFrame:
            try:
                return one(batch)
            except Exception as e:  # noqa: BLE001  the contract is an error column, not a failed run
                return batch.reindex(columns=names).assign(error=f"{type(e).__name__}: {e}", elapsed_ms=0.0)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not made:
                made.append(extractor.factory())
            for batch in batches:
                try:
                    yield one(batch)[[*names, "elapsed_ms", "error"]]
                except Exception:  # noqa: BLE001
                    for i in range(len(batch)):
                        yield row(batch.iloc[i : i + 1].reset_index(drop=True))[[*names, "elapsed_ms", "error"]]

        return frame.mapInPandas(work, extractor.schema + ", elapsed_ms double, error string")


#: The detection methods by name, in order, with what each needs: an expression over tables, or a model that a plug-in brings.
METHODS = (
    ("otsu_contour", False, ""), ("adaptive_contour", False, ""), ("canny_contour", False, "needs an edge detector"), ("grabcut", False, "needs a segmentation kernel"), ("color_cluster", False, "needs a clustering kernel"),
    ("hough_lines", False, ""), ("morph_gradient", False, ""), ("yolo_card", False, "needs model weights"), ("sift_homography", True, "needs descriptors"), ("akaze_homography", True, "needs descriptors"),
    ("orb_homography", True, "needs descriptors"), ("template_match", True, ""), ("ensemble_best", True, ""), ("pipeline_fused", True, ""),
)


def methods(spark: SparkSession) -> DataFrame:
    """ord, name, needs_template, available, reason: the dimension that rankings join."""
    return spark.createDataFrame([(i, n, t, not why, why) for i, (n, t, why) in enumerate(METHODS)], "ord int, name string, needs_template boolean, available boolean, reason string")
