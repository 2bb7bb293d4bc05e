"""The registry of extractors, briefs, the encoder, the lock and the fan-out."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import encoder
from tracewright.functions.scalars import marked_regions
from tracewright.operators import incremental
from tracewright.sources import brief, code, extractors
from tracewright.streaming import fanout


def small_model(vocabulary=30, size=8, heads=2, layers=2, inner=16):
    rng = np.random.default_rng(3)
    shapes = {"embeddings.word_embeddings.weight": (vocabulary, size), "embeddings.position_embeddings.weight": (256, size), "embeddings.token_type_embeddings.weight": (2, size)}
    shapes |= {f"embeddings.LayerNorm.{p}": (size,) for p in ("weight", "bias")}
    for k in range(layers):
        at = f"encoder.layer.{k}"
        for name, rows, columns in (("attention.self.query", size, size), ("attention.self.key", size, size), ("attention.self.value", size, size), ("attention.output.dense", size, size), ("intermediate.dense", inner, size), ("output.dense", size, inner)):
            shapes |= {f"{at}.{name}.weight": (rows, columns), f"{at}.{name}.bias": (rows,)}
        shapes |= {f"{at}.{name}.LayerNorm.{p}": (size,) for name in ("attention.output", "output") for p in ("weight", "bias")}
    return {k: rng.normal(size=v).astype(np.float32) for k, v in shapes.items()}, {"model_type": "bert", "num_hidden_layers": layers, "num_attention_heads": heads}


def plainly(tensors, config, ids):
    """One text's vector by loops over places and heads."""
    def norm(x, name):
        m = sum(x) / len(x)
        v = sum((a - m) ** 2 for a in x) / len(x)
        return np.array([(a - m) / math.sqrt(v + 1e-12) * w + b for a, w, b in zip(x, tensors[f"{name}.weight"], tensors[f"{name}.bias"])])

    def linear(x, name):
        return tensors[f"{name}.weight"].astype(float) @ x + tensors[f"{name}.bias"]

    x = [norm(tensors["embeddings.word_embeddings.weight"][t].astype(float) + tensors["embeddings.position_embeddings.weight"][i] + tensors["embeddings.token_type_embeddings.weight"][0], "embeddings.LayerNorm") for i, t in enumerate(ids)]
    for k in range(config["num_hidden_layers"]):
        at, width = f"encoder.layer.{k}", len(x[0]) // config["num_attention_heads"]
        q, keys, v = ([linear(a, f"{at}.attention.self.{p}") for a in x] for p in ("query", "key", "value"))
        seen = []
        for i in range(len(x)):
            parts = []
            for h in range(config["num_attention_heads"]):
                cut = slice(h * width, (h + 1) * width)
                s = [float(q[i][cut] @ y[cut]) / math.sqrt(width) for y in keys]
                e = [math.exp(a - max(s)) for a in s]
                parts.append(sum(a / sum(e) * y[cut] for a, y in zip(e, v)))
            seen.append(np.concatenate(parts))
        x = [norm(a + linear(b, f"{at}.attention.output.dense"), f"{at}.attention.output.LayerNorm") for a, b in zip(x, seen)]
        inner = [np.array([a * 0.5 * (1 + math.erf(a / math.sqrt(2))) for a in linear(y, f"{at}.intermediate.dense")]) for y in x]
        x = [norm(a + linear(b, f"{at}.output.dense"), f"{at}.output.LayerNorm") for a, b in zip(x, inner)]
    mean = sum(x) / len(x)
    return mean / np.linalg.norm(mean)


def test_encoder_equals_loops(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tensors, config = small_model()
    words = ["[PAD]", "[UNK]", *"alpha beta gamma delta epsilon".split()]
    tokenizer = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "config.json").write_text(json.dumps(config))
    header, body = {}, b""
    for name, value in tensors.items():
        header[name] = {"dtype": "F32", "shape": list(value.shape), "data_offsets": [len(body), len(body) + value.nbytes]}
        body += value.tobytes()
    raw = json.dumps(header | {"__metadata__": {"format": "pt"}}).encode()
    (tmp_path / "model.safetensors").write_bytes(len(raw).to_bytes(8, "little") + raw + body)
    rnd = random.Random(1)
    texts = [None, "", *(" ".join(rnd.choice(words[1:]) for _ in range(rnd.randint(1, 12))) for _ in range(20))]
    got = {r.k: r.vector for r in encoder.encode(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", str(tmp_path)).collect()}
    assert got[0] is None and got[1] is None
    for k, t in enumerate(texts[2:], 2):
        assert np.allclose(got[k], plainly(tensors, config, [words.index(w) if w in words else 1 for w in tokenizer.encode(t).tokens]), atol=1e-4)
    with pytest.raises(ValueError):
        encoder.Encoder(tensors, config | {"model_type": "other"})


def test_extractors(spark):
    text = "import os\n\nDEBUG = os.getenv('DEBUG')\n\n\ndef main():\n    return os.environ['HOME']\n\n\nif __name__ == '__main__':\n    main()\n"
    parsed = code.parse_files(spark.createDataFrame([("a/run.py", "python", text)], "path string, language string, text string"))
    made = extractors.extract(parsed, "config_keys", "entry_points")
    assert {r.key: r.reads for r in made["config_keys"].collect()} == {"DEBUG": ["a/run.py:3"], "HOME": ["a/run.py:7"]}
    assert {tuple(r) for r in made["entry_points"].collect()} == {("guard", "a/run.py"), ("main", "a/run.py:main")}
    assert set(extractors.extract(parsed)) >= {"routes", "config_keys", "entry_points", "smells"}
    with pytest.raises(KeyError):
        extractors.extract(parsed, "none")
    with pytest.raises(ValueError):
        extractors.extractor("routes")(lambda parsed: parsed)


def test_brief_keeps_its_cap(spark):
    facts = [("Size", "12 files"), ("Long", "x" * 3000), ("Run", "make test")]
    text = brief.render("thing", facts, {"purpose": "What it is for.", "none": " "}, most=100)
    assert brief.tokens(text) <= 100 and "- Size: 12 files\n- Run: make test" in text and "xxx" not in text
    got = spark.createDataFrame([(text,)], "t string").select(marked_regions(F.col("t")).alias("r")).first().r
    assert [(r.kind, r.name) for r in got] == [("generated", "facts"), ("narrative", "purpose")]


def test_one_update_at_a_time(spark, tmp_path):
    folder = f"file://{tmp_path}"
    with incremental.UpdateLock(spark, folder):
        with pytest.raises(incremental.Busy), incremental.UpdateLock(spark, folder, wait=0.2):
            pass
        with incremental.UpdateLock(spark, folder, wait=5, stale_after=-1.0):
            pass
    with incremental.UpdateLock(spark, folder, wait=0.2):
        pass


def test_slow_listeners_miss_events(spark, tmp_path):
    hub = fanout.FanOut(3)
    slow, gone = hub.listen(), hub.listen()
    hub.leave(gone)
    assert [hub.publish(str(i)) for i in range(5)] == [1, 1, 1, 0, 0] and slow.qsize() == 3 and gone.empty()
    spark.createDataFrame([(2, "b"), (1, "a")], "id long, v string").write.json(str(tmp_path / "in"))
    heard = hub.listen()
    stream = spark.readStream.schema("id long, v string").json(str(tmp_path / "in"))
    fanout.feed(stream, hub, str(tmp_path / "check"), "id").awaitTermination()
    assert [json.loads(heard.get_nowait())["v"] for _ in range(2)] == ["a", "b"]
