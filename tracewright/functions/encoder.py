"""Sentence vectors of a BERT encoder with mean pooling, in NumPy, Arrow batch by batch.

A model is a folder with ``config.json``, ``tokenizer.json`` and ``model.safetensors``; no model comes with this package.  Its
bytes are broadcast, up to ``MOST_BYTES``; each task builds the encoder once.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Tokens of a text that the encoder sees, texts in a batch, and bytes of a model that are broadcast at most.
TOKENS, TEXTS, MOST_BYTES = 256, 64, 1 << 30
KINDS = {"F64": np.float64, "F32": np.float32, "F16": np.float16, "I64": np.int64, "I32": np.int32}
_erf = np.frompyfunc(math.erf, 1, 1)


def read_tensors(raw: bytes) -> dict[str, np.ndarray]:
    """The arrays of a safetensors file: a header's length, the header in JSON, then the arrays."""
    size = int.from_bytes(raw[:8], "little")
    header, body = json.loads(raw[8 : 8 + size]), memoryview(raw)[8 + size :]
    return {
        name: np.frombuffer(body[slice(*about["data_offsets"])], KINDS[about["dtype"]]).reshape(about["shape"]).astype(np.float32)
        for name, about in header.items()
        if name != "__metadata__" and about["dtype"] in KINDS
    }


class Encoder:
    """Attention layers over token, place and segment vectors; a text's vector is the mean of its tokens', of length one."""

    def __init__(self, tensors: dict[str, np.ndarray], config: dict):
        if config.get("model_type", "bert") != "bert":
            raise ValueError(f"no BERT encoder: {config.get('model_type')}")
        self.of = {k.removeprefix("bert."): v for k, v in tensors.items()}
        self.layers, self.heads, self.tiny = config["num_hidden_layers"], config["num_attention_heads"], config.get("layer_norm_eps", 1e-12)

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + self.tiny) * self.of[f"{name}.weight"] + self.of[f"{name}.bias"]

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.of[f"{name}.weight"].T + self.of[f"{name}.bias"]

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Unit vectors of token numbers (texts, places), of which ``mask`` says which are there."""
        texts, places = ids.shape
        table = "embeddings"
        x = self.of[f"{table}.word_embeddings.weight"][ids] + self.of[f"{table}.position_embeddings.weight"][:places] + self.of[f"{table}.token_type_embeddings.weight"][0]
        x = self._norm(x, f"{table}.LayerNorm")
        hidden = np.where(mask[:, None, None, :] > 0, 0.0, -1e9)
        for k in range(self.layers):
            at = f"encoder.layer.{k}"
            query, keys, values = (self._linear(x, f"{at}.attention.self.{part}").reshape(texts, places, self.heads, -1).swapaxes(1, 2) for part in ("query", "key", "value"))
            scores = query @ keys.swapaxes(-1, -2) / math.sqrt(query.shape[-1]) + hidden
            scores = np.exp(scores - scores.max(-1, keepdims=True))
            seen = (scores / scores.sum(-1, keepdims=True) @ values).swapaxes(1, 2).reshape(texts, places, -1)
            x = self._norm(x + self._linear(seen, f"{at}.attention.output.dense"), f"{at}.attention.output.LayerNorm")
            inner = self._linear(x, f"{at}.intermediate.dense")
            inner = inner * 0.5 * (1 + _erf(inner / math.sqrt(2)).astype(np.float64))
            x = self._norm(x + self._linear(inner, f"{at}.output.dense"), f"{at}.output.LayerNorm")
        mean = (x * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def encode(df: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """(key, vector): the unit vectors of texts; of null and empty texts, null."""
    place = Path(folder)
    parts = {name: (place / name).read_bytes() for name in ("config.json", "tokenizer.json", "model.safetensors")}
    if (size := sum(map(len, parts.values()))) > MOST_BYTES:
        raise ValueError(f"the model has {size} bytes; at most {MOST_BYTES} are broadcast")
    known = df.sparkSession.sparkContext.broadcast(parts)

    def run(frames):
        from tokenizers import Tokenizer

        raw = known.value
        tokenizer = Tokenizer.from_str(raw["tokenizer.json"].decode())
        tokenizer.enable_truncation(TOKENS)
        tokenizer.enable_padding()
        model = Encoder(read_tensors(raw["model.safetensors"]), json.loads(raw["config.json"]))
        for frame in frames:
            vectors: list = [None] * len(frame)
            some = [i for i, t in enumerate(frame[text]) if t]
            some.sort(key=lambda i: len(frame[text].iloc[i]))  # texts of one length need little padding
            for start in range(0, len(some), TEXTS):
                part = some[start : start + TEXTS]
                found = tokenizer.encode_batch([frame[text].iloc[i] for i in part])
                made = model(np.array([e.ids for e in found]), np.array([e.attention_mask for e in found], dtype=np.float32))
                for i, vector in zip(part, made, strict=True):
                    vectors[i] = vector.astype(float).tolist()
            yield pd.DataFrame({key: frame[key], "vector": vectors})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, vector array<double>")
