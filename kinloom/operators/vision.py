"""Files to faces with pluggable decoder, detector and embedder.

No weights come with the engine: callers hand in callables, which each Python worker builds
once. An error is kept with its photo and stops nothing else."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

FACES = "path string, face_index int, x0 double, y0 double, x1 double, y1 double, det_score double, embedding array<float>, error string"


def process(photos: DataFrame, build: Callable[[], Callable[[bytes], list[dict]]], batch_bytes: int = 32 << 20) -> DataFrame:
    """A row for each face of photos (path, content). `build` makes a function from bytes to faces
    (x0, y0, x1, y1, det_score, embedding); a photo without faces gives none, one that fails a row with its error."""
    photos.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))

    def run(batches):
        detect = build()
        blank = {c.split()[0]: None for c in FACES.split(", ")}
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [blank | {"path": path, "face_index": k} | face for k, face in enumerate(detect(bytes(content)))]
                except Exception as e:  # one bad photo must not lose the others
                    rows.append(blank | {"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=list(blank), dtype=object).astype({"face_index": "Int32"} | dict.fromkeys(("x0", "y0", "x1", "y1", "det_score"), "float64"))

    return photos.select("path", "content").mapInPandas(run, FACES)
