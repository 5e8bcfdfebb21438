"""The state of a fit after each averaging round, as tables that a later run takes up.

A state is one folder with the parameters in blocks and a row of everything else. It counts
once its writer has committed it, so a fit that dies while writing goes on from the state
before. The last two are kept.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import SparkSession

from ..operators.averaging import BLOCK
from ..operators.training import Model
from ..session import delete_path, names_in, path_exists

SCHEMA = "kind string, block int, params array<double>, updater array<double>, meta string"
KEPT = 2
_PREFIX = "round-"


@dataclass(frozen=True)
class FitState:
    """What a fit knows between two rounds; ``epoch`` and ``split`` are the next to do."""

    fit: str
    epoch: int
    split: int
    rounds: int
    model: Model
    best: Model
    best_epoch: int = -1
    best_loss: float = math.inf
    losses: list[float] = field(default_factory=list)
    history: list[tuple[int, float, float | None]] = field(default_factory=list)


def save_state(spark: SparkSession, folder: str, state: FitState) -> None:
    rows = []
    for kind, model in (("current", state.model), ("best", state.best)):
        for block, lo in enumerate(range(0, len(model.params), BLOCK)):
            part = slice(lo, lo + BLOCK)
            rows.append((kind, block, model.params[part].tolist(), model.updater[part].tolist(), None))
    known = asdict(replace(state, model=None, best=None)) | {"head": [state.model.head, state.model.n_features, state.model.n_labels]}
    rows.append(("meta", 0, None, None, json.dumps(known)))
    folder = folder.rstrip("/")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{_PREFIX}{state.rounds:09d}")
    for name in _committed(spark, folder)[:-KEPT]:
        delete_path(spark, f"{folder}/{name}")


def _committed(spark: SparkSession, folder: str) -> list[str]:
    names = [n for n in names_in(spark, folder) if n.startswith(_PREFIX)]
    return [n for n in names if path_exists(spark, f"{folder}/{n}/_SUCCESS")]


def load_state(spark: SparkSession, folder: str) -> FitState | None:
    """The newest state that was written whole, or None."""
    folder = folder.rstrip("/")
    names = _committed(spark, folder)
    if not names:
        return None
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/{names[-1]}").collect()
    known = json.loads(next(r["meta"] for r in rows if r["kind"] == "meta"))
    head = known.pop("head")
    models = {}
    for kind in ("current", "best"):
        blocks = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["block"])
        vectors = [np.array([x for r in blocks for x in r[name]], np.float64) for name in ("params", "updater")]
        models[kind] = Model(*head, *vectors)
    known["history"] = [tuple(h) for h in known["history"]]
    return FitState(**(known | {"model": models["current"], "best": models["best"]}))
