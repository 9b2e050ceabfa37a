"""Registry layers from feature services, page by page, as the saved answers that ``registry`` parses."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The national grid, in which tiles are numbered.
GRID = "EPSG:28992"


def page_url(url: str, layer: str, box: dict, begin: int, count: int, grid: str = GRID) -> str:
    """A web feature service's request for some features of a layer in a box."""
    corners = ",".join(str(box[c]) for c in ("x_min", "y_min", "x_max", "y_max"))
    query = {"service": "WFS", "version": "2.0.0", "request": "GetFeature", "typeNames": layer, "srsName": grid, "bbox": f"{corners},{grid}", "outputFormat": "application/json", "startIndex": begin, "count": count}
    return f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(query)}"


def fetch_layers(spark: SparkSession, url: str, layers: list[str], box: dict, count: int = 1000, timeout: float = 60) -> DataFrame:
    """``layer, page, json``: all features of each layer in a box, ``count`` a page; one task a layer.

    A page with fewer features than asked for is the last one. A lost task asks for its layer again; an answer that isn't
    JSON, or a refused request, fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer in batch.column("layer").to_pylist():
                page = 0
                while True:
                    with urllib.request.urlopen(page_url(url, layer, box, page * count, count), timeout=timeout) as answer:
                        text = answer.read().decode()
                    n = len(json.loads(text).get("features") or [])
                    if n or not page:
                        yield pa.RecordBatch.from_arrays([pa.array([layer]), pa.array([page], pa.int32()), pa.array([text])], ["layer", "page", "json"])
                    page += 1
                    if n < count:
                        break

    asked = spark.createDataFrame([(layer,) for layer in layers], "layer string").repartition(max(1, len(layers)), "layer")
    return asked.mapInArrow(run, "layer string, page int, json string")


def fetch_signs(spark: SparkSession, url: str, town: str, timeout: float = 60) -> DataFrame:
    """``json``: a town's traffic signs, for ``registry.parse_signs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code in batch.column("town").to_pylist():
                with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode({'town-code': code})}", timeout=timeout) as answer:
                    yield pa.RecordBatch.from_arrays([pa.array([answer.read().decode()])], ["json"])

    return spark.createDataFrame([(town,)], "town string").mapInArrow(run, "json string")
