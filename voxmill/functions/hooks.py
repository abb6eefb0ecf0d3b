"""User code over one frame at a time."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def score_frames(vox: DataFrame, predict: Callable[[dict], np.ndarray], inputs: list[str], done: DataFrame | None = None) -> DataFrame:
    """Label every voxel of each frame with ``predict({column: array}) -> labels``.

    A frame has a fixed number of cells, which bounds what a task holds. Frames in ``done``
    are skipped before anything is moved."""
    todo = vox if done is None else vox.join(done.select("frame"), "frame", "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("flat")
        labels = predict({c: pdf[c].to_numpy() for c in inputs})
        return pd.DataFrame({"frame": pdf["frame"].to_numpy(), "flat": pdf["flat"].to_numpy(), "pred": np.asarray(labels, np.int32)})

    ft = vox.schema["frame"].dataType.simpleString()
    cols = list(dict.fromkeys(["frame", "flat", *inputs]))
    return todo.select(*cols).groupBy("frame").applyInPandas(run, f"frame {ft}, flat int, pred int")
