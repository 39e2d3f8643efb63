"""Batched scores of a trained two-branch residual network, in numpy over Arrow batches.

A member's weights are a .npz file; a network is a folder of members, whose logits are averaged. Workers read the folder
once, from the store that all of them share, so weights are in no closure and no task's message.

Arrays of a member: ``tabular``, ``mlp_in``, ``mlp_out``, ``project``, ``fuse`` and ``head`` are layers with a ``.w``
(out x in) and a ``.b``; ``classes`` and ``syndromes`` are tables of vectors; ``block0.first``, ``block0.second`` and so on
are the layers of the residual blocks. Layers that are normalised have ``.g`` and ``.o`` (gain and offset): tabular, mlp_in
and fuse after their product, the blocks' layers and the head before it.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from locusframe.sources.bgzf import opened

#: Added to a variance before its root is taken.
_EPSILON = 1e-5
_STEP, _REACH = 1 / 1024, 6.0
_GRID = np.arange(-_REACH, _REACH + 2 * _STEP, _STEP)
_ERF = np.array([math.erf(x) for x in _GRID])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-(_GRID**2))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, by cubics through its values and slopes on a fine grid (error under 1e-13)."""
    near = np.clip(x, -_REACH, _REACH)
    at = ((near + _REACH) / _STEP).astype(np.int64)
    t = (near - _GRID[at]) / _STEP
    a, b, p, q = _ERF[at], _ERF[at + 1], _SLOPE[at] * _STEP, _SLOPE[at + 1] * _STEP
    return a + t * (p + t * (3 * (b - a) - 2 * p - q + t * (2 * (a - b) + p + q)))


def _active(x: np.ndarray) -> np.ndarray:
    """The Gaussian error linear unit."""
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


class Member:
    """One network's forward pass over a batch."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = {k: np.asarray(v, dtype=np.float64) for k, v in arrays.items()}
        self.blocks = sum(1 for k in self.arrays if k.startswith("block") and k.endswith(".first.w"))

    def _product(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.arrays[f"{name}.w"].T + self.arrays[f"{name}.b"]

    def _even(self, name: str, x: np.ndarray) -> np.ndarray:
        middle = x - x.mean(axis=1, keepdims=True)
        return middle / np.sqrt((middle**2).mean(axis=1, keepdims=True) + _EPSILON) * self.arrays[f"{name}.g"] + self.arrays[f"{name}.o"]

    def logits(self, tabular: np.ndarray, classes: np.ndarray, syndromes: np.ndarray, llr: np.ndarray, available: np.ndarray, embedding: np.ndarray) -> np.ndarray:
        shape = lambda name, x: _active(self._even(name, self._product(name, x)))
        second = self._product("mlp_out", shape("mlp_in", np.hstack([llr[:, None], available[:, None], self._product("project", embedding)])))
        x = shape("fuse", np.hstack([shape("tabular", tabular), self.arrays["classes"][classes], self.arrays["syndromes"][syndromes], second]))
        for i in range(self.blocks):
            y = x
            for part in ("first", "second"):
                y = self._product(f"block{i}.{part}", _active(self._even(f"block{i}.{part}", y)))
            x = x + y
        return self._product("head", _active(self._even("head", x)))[:, 0]

    @property
    def width(self) -> int:
        """Numbers of an embedding."""
        return self.arrays["project.w"].shape[1]


def save_network(members: list[dict[str, np.ndarray]], path: str) -> None:
    """Writes members into a new folder of the shared store."""
    system, folder = opened(path)
    system.create_dir(folder, recursive=True)
    for i, arrays in enumerate(members):
        packed = io.BytesIO()
        np.savez(packed, **arrays)
        with system.open_output_stream(f"{folder}/member-{i:04d}.npz") as out:
            out.write(packed.getvalue())


@lru_cache(maxsize=2)
def network(path: str) -> list[Member]:
    """The worker's own members of a folder."""
    system, folder = opened(path)
    found = []
    for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if info.path.endswith(".npz"):
            with system.open_input_file(info.path) as file:
                found.append(Member(dict(np.load(io.BytesIO(file.read())))))
    if not found:
        raise FileNotFoundError(f"no members in {path}")
    return found


def network_logits(rows: DataFrame, path: str, tabular: list[str], class_id: str, syndrome_id: str, llr: str, available: str, embedding: str, output: str = "logit", scale: float | None = None, bias: float = 0.0) -> DataFrame:
    """``rows`` with the members' mean logit, or with ``scale`` the calibrated probability 1 / (1 + exp(-(scale x logit + bias))).

    A null tabular value is 0. Without an embedding, or where ``available`` is null or 0, the second branch gets zeros
    for all of llr, available and embedding. A null class or syndrome, or one outside the tables, raises.
    """
    schema, names = StructType([*rows.schema.fields, StructField(output, DoubleType())]), rows.columns
    used = {"_n_tab": F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in tabular]), "_n_class": F.col(class_id).cast("bigint"), "_n_syn": F.col(syndrome_id).cast("bigint"), "_n_llr": F.coalesce(F.col(llr).cast("double"), F.lit(0.0)), "_n_av": F.coalesce(F.col(available).cast("double"), F.lit(0.0)), "_n_emb": F.col(embedding).cast("array<double>")}

    def ids(batch: pa.RecordBatch, name: str, most: int, what: str) -> np.ndarray:
        column = batch.column(name)
        if column.null_count:
            raise ValueError(f"null {what}")
        values = column.to_numpy(zero_copy_only=False)
        if len(values) and not (0 <= values.min() and values.max() < most):
            raise ValueError(f"{what} outside 0 to {most - 1}")
        return values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = network(path)
        for batch in batches:
            n, arrays = batch.num_rows, members[0].arrays
            table = batch.column("_n_tab").flatten().to_numpy(zero_copy_only=False).reshape(n, -1 if n else 0)
            told = batch.column("_n_emb")
            there = np.flatnonzero(told.is_valid().to_numpy(zero_copy_only=False) & (batch.column("_n_av").to_numpy(zero_copy_only=False) != 0))
            vectors = np.zeros((n, members[0].width))
            vectors[there] = told.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).reshape(len(there), members[0].width)
            held = np.zeros(n)
            held[there] = 1.0
            given = (table, ids(batch, "_n_class", len(arrays["classes"]), class_id), ids(batch, "_n_syn", len(arrays["syndromes"]), syndrome_id), batch.column("_n_llr").to_numpy(zero_copy_only=False) * held, batch.column("_n_av").to_numpy(zero_copy_only=False) * held, vectors)
            logit = np.mean([m.logits(*given) for m in members], axis=0) if n else np.zeros(0)
            made = logit if scale is None else 1 / (1 + np.exp(-(scale * logit + bias)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(made, pa.float64())], [*names, output])

    return rows.withColumns(used).mapInArrow(run, schema)
