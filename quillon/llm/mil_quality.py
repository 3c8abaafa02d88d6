"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded as a vector of statistics and passed through a small layer;
gated attention weighs the passages, and the weighted mean decides. Only document labels are needed: which passages
matter is learned with the rest. Fitting takes a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import wordnum
from quillon.llm.labelled import fold_of, sample
from quillon.llm.wordnum import Words

PASSAGE_WORDS = 40
_CLASSES = ["upper", "lower", "digit", "star", "dollar", "percent", "ampersand", "hash", "pipe", "bang", "stop", "angle", "other", "wide"]


def _classes() -> np.ndarray:
    out = np.full(256, _CLASSES.index("other"), dtype=np.int8)
    out[65:91], out[97:123], out[48:58], out[128:] = 0, 1, 2, _CLASSES.index("wide")
    for name, chars in {"star": "*", "dollar": "$", "percent": "%", "ampersand": "&", "hash": "#", "pipe": "|", "bang": "!", "stop": ".,;:?", "angle": "<>"}.items():
        out[[ord(c) for c in chars]] = _CLASSES.index(name)
    return out


_class = _classes()
FEATURES = len(_CLASSES) + 9


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of FEATURES for each passage, index of each text's first passage and the end). A text has one at least."""
    words = Words(buf, off)
    n, parts = words.n, np.maximum(1, -(-words.n // PASSAGE_WORDS))
    bag = np.append(0, np.cumsum(parts))
    of = np.repeat(np.arange(len(n)), parts)
    first = np.append(words.first[of] + (np.arange(bag[-1]) - bag[of]) * PASSAGE_WORDS, words.first[-1])
    last = np.minimum(first[:-1] + PASSAGE_WORDS, words.first[of + 1])
    size = (last - first[:-1]).astype(np.float64)
    full = np.maximum(size, 1)
    if not len(words.start):
        return np.zeros((len(of), FEATURES), dtype=np.float32), bag

    def over(x: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(x, dtype=np.float64))
        return total[last] - total[first[:-1]]

    inside = ~wordnum._space[buf]
    kind = _class[buf]
    kind = np.where((kind == len(_CLASSES) - 1) & (np.append(0, buf[:-1]) == 0xC3) & (buf >= 0x80) & (buf <= 0x9E), 0, kind)
    begin, end = words.start[np.minimum(first[:-1], len(words.start) - 1)], words.end[np.maximum(last - 1, 0)]
    empty = size == 0
    end = np.where(empty, begin, end)
    chars = np.append(0, np.cumsum(inside))
    chars = np.maximum(1, chars[end] - chars[begin]).astype(np.float64)
    out = np.zeros((len(of), FEATURES), dtype=np.float32)
    for i in range(len(_CLASSES)):
        total = np.append(0, np.cumsum((kind == i) & inside))
        out[:, i] = np.sqrt((total[end] - total[begin]) / chars)
    length = (words.end - words.start).astype(np.float64)
    h = words.hashes()
    owner = np.repeat(np.arange(len(of)), (last - first[:-1]))
    order = np.lexsort((h, owner))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
    mean = over(length) / full
    lead = buf[words.start]
    at = len(_CLASSES)
    out[:, at] = np.log1p(size)
    out[:, at + 1] = np.log1p(mean)
    out[:, at + 2] = np.sqrt(np.maximum(0, over(length * length) / full - mean**2)) / 5
    out[:, at + 3] = np.bincount(owner[order][new], minlength=len(of)) / full
    out[:, at + 4] = over(np.append(False, h[1:] == h[:-1])) / full
    out[:, at + 5] = over((lead >= 65) & (lead <= 90)) / full
    out[:, at + 6] = over(length == 1) / full
    out[:, at + 7] = over(np.isin(buf[words.end - 1], np.frombuffer(b".!?", np.uint8))) / full
    out[:, at + 8] = over(length > 25) / full
    return out, bag


@dataclass
class Model:
    """mean, scale: of the features. w, b: encoder. v, u, a: gated attention. c, d: decision."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(z @ p["v"]), 1 / (1 + np.exp(-(z @ p["u"])))
        e = (t * g) @ p["a"]
        start, of = bag[:-1], np.repeat(np.arange(len(bag) - 1), np.diff(bag))
        e = np.exp(e - np.maximum.reduceat(e, start)[of])
        weight = e / np.add.reduceat(e, start)[of]
        m = np.add.reduceat(weight[:, None] * z, start)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))
        return {"z": z, "t": t, "g": g, "weight": weight, "m": m, "y": y, "of": of}

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, bag)["y"]


def fit(x: np.ndarray, bag: np.ndarray, label: np.ndarray, *, hidden: int = 16, gates: int = 8, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> Model:
    """Adam on the log loss of bags; a constant decision where there are no bags or only one label."""
    rng = np.random.default_rng(seed)
    shape = {"w": (x.shape[1], hidden), "b": (hidden,), "v": (hidden, gates), "u": (hidden, gates), "a": (gates,), "c": (hidden,), "d": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "ac" else np.zeros(s) for k, s in shape.items()}
    model = Model(x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) + 0.02 if len(x) else np.ones(x.shape[1]), p)
    if len(np.unique(label)) < 2:
        p["c"][:] = 0
        p["d"][:] = 4.0 if not len(label) or label[0] else -4.0
        return model
    x = (x - model.mean) / model.scale
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            size = (bag[own + 1] - bag[own]).astype(int)
            rows = np.concatenate([np.arange(bag[i], bag[i + 1]) for i in own])
            f = model.forward(x[rows], np.append(0, np.cumsum(size)))
            of, z, t, g, weight = f["of"], f["z"], f["t"], f["g"], f["weight"]
            dy = (f["y"] - label[own]) / len(own)
            dm = dy[:, None] * p["c"]
            dz = weight[:, None] * dm[of]
            de = weight * np.sum((z - f["m"][of]) * dm[of], 1)
            dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
            dz = (dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - z * z)
            slope = {"w": x[rows].T @ dz, "b": dz.sum(0), "v": z.T @ dt, "u": z.T @ dg, "a": (t * g).T @ de, "c": f["m"].T @ dy, "d": np.array([dy.sum()])}
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, s in slope.items():
                s = s + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * s
                second[k] = 0.999 * second[k] + 0.001 * s * s
                p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, *, label_column: str = "quality", folds: int = 5, held_out: int = 0, most: int = 6000, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on at most ``most`` labelled rows outside the held-out fold; only their passages' statistics reach the driver."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = wordnum.flat(batch.column(2))
            for lo, hi in wordnum.slices(off):
                x, bag = passages(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([x[a:b].tobytes() for a, b in zip(bag, bag[1:], strict=False)], pa.binary())], names=["doc_id", "label", "bag"])

    known = sample(docs, labels, label_column, folds, held_out, most, id_column, text_column)
    schema = T.StructType([known.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("bag", T.BinaryType())])
    rows = sorted(known.mapInArrow(encode, schema).collect(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES))
    return fit(x.astype(np.float64), np.append(0, np.cumsum([len(b) for b in bags])).astype(int), np.array([r["label"] for r in rows], dtype=np.float64))


def score(spark: SparkSession, docs: DataFrame, model: Model, *, column: str = "score", text_column: str = "text") -> DataFrame:
    """``docs`` with ``column``: 0 to 1, higher where label 1 is likelier, from every passage of the whole text.

    A null or empty text is one empty passage. Rows are scored one by one, so repeated rows score alike; an existing
    column of that name is replaced; an empty table stays empty.
    """
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers
    plain = docs.drop(column)
    at = plain.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = wordnum.flat(batch.column(at))
            found = [np.zeros(0)]
            for lo, hi in wordnum.slices(off):
                found.append(shared.value.score(*passages(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=[*batch.schema.names, column])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(column, T.DoubleType())]))


def op7_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label_column="quality", folds=5, held_out=0)
    scored = score(spark, docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
