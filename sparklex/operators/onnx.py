"""Text embedding with an ONNX encoder: an Arrow iterator with one session a worker, batches sorted by length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

#: A model beyond this is not broadcast.
MAX_MODEL_BYTES = 2_000_000_000
OUTPUTS = ("sentence_embedding", "pooler_output", "last_hidden_state", "token_embeddings")
_SESSIONS: dict = {}


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked means over tokens (rank 3), or the vectors as they are (rank 2); each brought to unit length."""
    if hidden.ndim == 3:
        m = mask[..., None].astype(np.float32)
        hidden = (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    n = np.linalg.norm(hidden.astype(np.float64), axis=1, keepdims=True)
    return np.where(n > 0, hidden / np.maximum(n, 1e-300), hidden).astype(np.float32)


def run_session(session, ids: list[list[int]], batch: int = 32) -> list[np.ndarray]:
    """The vectors of id lists, in their order; rows of like length share a padded batch."""
    names = {i.name for i in session.get_inputs()}
    outputs = [o.name for o in session.get_outputs()]
    out_name = next((o for o in OUTPUTS if o in outputs), outputs[0])
    order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
    out: list = [None] * len(ids)
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        width = max(1, max(len(ids[i]) for i in some))
        x = np.zeros((len(some), width), dtype=np.int64)
        mask = np.zeros_like(x)
        for r, i in enumerate(some):
            x[r, : len(ids[i])], mask[r, : len(ids[i])] = ids[i], 1
        feed = {"input_ids": x, "attention_mask": mask, "token_type_ids": np.zeros_like(x)}
        [hidden] = session.run([out_name], {k: v for k, v in feed.items() if k in names})
        for i, v in zip(some, pool(np.asarray(hidden), mask)):
            out[i] = v
    return out


def embed(df: DataFrame, ids: str, model: bytes, batch: int = 32):
    """``df`` with ``embedding`` from a column of id lists (without padding); a null list gives null."""
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"models of over {MAX_MODEL_BYTES} bytes are not broadcast")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        import onnxruntime

        key = hash(shared.value)
        if key not in _SESSIONS:
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            _SESSIONS[key] = onnxruntime.InferenceSession(shared.value, options, providers=["CPUExecutionProvider"])
        for s in parts:
            at = [i for i, x in enumerate(s) if x is not None]
            got = run_session(_SESSIONS[key], [[int(t) for t in s.iloc[i]] for i in at], batch)
            out: list = [None] * len(s)
            for i, v in zip(at, got):
                out[i] = v.tolist()
            yield pd.Series(out)

    from collections.abc import Iterator

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("embedding", F.pandas_udf(run, ArrayType(FloatType()))(F.col(ids)))
