"""Quality by a small byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole document. Each
byte is a symbol: its value, and whether the ``REPEAT`` bytes that end with it also occur
up to ``LAG`` bytes earlier. Learned filters run over the embedded symbols of a chunk;
their rectified outputs are averaged and max-pooled over the chunk, a second layer mixes
them, and its outputs are averaged and max-pooled over the document's chunks and combined
into one probability. All weights are fitted by Adam on a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import tidy
from shiftlab.llm.labelled import held_out, sample

#: Labelled rows used for fitting, and the chunks of one text among them (spread over all of it).
SAMPLE_ROWS, SAMPLE_CHUNKS = 1_000, 24
CHUNK, STEP = 512, 256
WIDTH, STRIDE = 8, 4
CHANNELS, FILTERS, HIDDEN = 4, 12, 8
REPEAT, LAG = 8, 40
#: Chunks handled at once: bounds the memory of a task.
BLOCK = 1024


def symbols(data: bytes) -> np.ndarray:
    """One number per byte: its value, plus 256 where the last REPEAT bytes repeat."""
    x = np.frombuffer(data, np.uint8)
    out = x.astype(np.int16)
    if len(x) <= REPEAT:
        return out
    repeated = np.zeros(len(x), bool)
    for lag in range(2, min(LAG, len(x) - REPEAT) + 1):
        same = x[lag:] == x[:-lag]
        run = same
        for shift in (1, 2, 4):                                    # REPEAT = 8 equal bytes in a row
            run = run[shift:] & run[:-shift]
        repeated[lag + REPEAT - 1:] |= run
    return out + repeated.astype(np.int16) * 256


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks over the whole text (rows of CHUNK symbols; 512 pads the last)."""
    s = symbols(data)
    n = max(1, -(-(len(s) - CHUNK) // STEP) + 1)
    padded = np.full((n - 1) * STEP + CHUNK, 512, np.int16)
    padded[:len(s)] = s
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (513, CHANNELS)),
            "w1": r.normal(0, (2 / (WIDTH * CHANNELS)) ** 0.5, (WIDTH * CHANNELS, FILTERS)), "b1": np.zeros(FILTERS),
            "w2": r.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)), "b2": np.full(HIDDEN, 0.1),
            "w3": r.normal(0, 0.3, 2 * HIDDEN), "b3": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][512] = 0

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """The embedded windows of every chunk: (chunks, places, WIDTH * CHANNELS)."""
        e = self.p["emb"][x].reshape(len(x), -1)
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH * CHANNELS, axis=1)[:, ::STRIDE * CHANNELS]
        return np.ascontiguousarray(w)

    def pooled(self, x: np.ndarray, keep: bool = False):
        """Averages and maxima of the filters over each chunk."""
        c = self._columns(x)
        a = np.maximum(c.reshape(-1, c.shape[2]) @ self.p["w1"] + self.p["b1"], 0).reshape(len(x), -1, FILTERS)
        h = np.concatenate([a.mean(axis=1), a.max(axis=1)], axis=1)
        return (h, c, a) if keep else h

    def probabilities(self, texts: list) -> np.ndarray:
        """One per text; the chunks of many texts go through the filters together."""
        parts = [chunks((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        n = np.array([len(p) for p in parts])
        flat, at = np.concatenate(parts), np.cumsum(n) - n
        h = np.concatenate([self.pooled(flat[i:i + BLOCK]) for i in range(0, len(flat), BLOCK)])
        z = np.maximum(h @ self.p["w2"] + self.p["b2"], 0)
        d = np.concatenate([np.maximum.reduceat(z, at), np.add.reduceat(z, at) / n[:, None]], axis=1)
        return 1 / (1 + np.exp(-np.clip((d @ self.p["w3"] + self.p["b3"][0]).astype(float), -30, 30)))

    def gradients(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        p = self.p
        x = np.concatenate(docs)
        n = np.array([len(d) for d in docs])
        owner, at = np.repeat(np.arange(len(docs)), n), np.cumsum(n) - n
        h, c, a = self.pooled(x, keep=True)
        pre = h @ p["w2"] + p["b2"]
        z = np.maximum(pre, 0)
        top = np.maximum.reduceat(z, at)
        d = np.concatenate([top, np.add.reduceat(z, at) / n[:, None]], axis=1)
        prob = 1 / (1 + np.exp(-np.clip(d @ p["w3"] + p["b3"][0], -30, 30)))
        loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).mean())
        g = ((prob - y) * weight / len(docs)).astype(p["w3"].dtype)
        out = {"w3": d.T @ g, "b3": np.array([g.sum()])}
        gd = g[:, None] * p["w3"]
        gz = (z == top[owner]) * gd[owner, :HIDDEN] + (gd[:, HIDDEN:] / n[:, None])[owner]
        gz *= pre > 0
        out["w2"], out["b2"] = h.T @ gz, gz.sum(axis=0)
        gh = gz @ p["w2"].T
        ga = np.repeat(gh[:, None, :FILTERS] / a.shape[1], a.shape[1], axis=1)
        best = a.argmax(axis=1)
        ga[np.arange(len(a))[:, None], best, np.arange(FILTERS)[None, :]] += gh[:, FILTERS:]
        ga *= a > 0
        flat = ga.reshape(-1, FILTERS)
        out["w1"], out["b1"] = c.reshape(-1, c.shape[2]).T @ flat, flat.sum(axis=0)
        gc = (flat @ p["w1"].T).reshape(len(x), -1, WIDTH, CHANNELS)
        emb = np.zeros_like(p["emb"], dtype=np.float64)
        places = np.arange(gc.shape[1]) * STRIDE
        for j in range(WIDTH):
            s = x[:, places + j].reshape(-1)
            for k in range(CHANNELS):
                emb[:, k] += np.bincount(s, weights=gc[:, :, j, k].reshape(-1), minlength=513)
        emb[512] = 0
        out["emb"] = emb
        return out, loss


def train(texts: list[str], labels: list[int], **how) -> Network:
    """:func:`train_on_chunks` with all chunks of the texts."""
    return train_on_chunks([chunks(t.encode("utf-8", "surrogatepass")) for t in texts], labels, **how)


def train_on_chunks(parts: list[np.ndarray], labels: list[int], rounds: int = 5, batch: int = 24, rate: float = 0.01,
                    seed: int = 7) -> Network:
    """Fit by Adam; both labels weigh the same. With one label or none, the network answers
    that label's side (0.5 without rows) for every text."""
    net = Network(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.p["w3"][:] = 0
        net.p["b3"][:] = 0 if not len(y) else (3 if y[0] else -3)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    r, step = np.random.default_rng(seed), 0
    for _ in range(rounds):
        order = r.permutation(len(y))
        for i in range(0, len(order), batch):
            pick = order[i:i + batch]
            g, _ = net.gradients([parts[j] for j in pick], y[pick], weight[pick])
            step += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9 ** step))
                            / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def _sampled_chunks(most: int):
    """(text, label) -> (chunks, label): at most ``most`` chunks of a text, spread evenly over it."""
    def run(batches):
        for batch in batches:
            parts = []
            for t in batch.column("text").to_pylist():
                c = chunks((t or "").encode("utf-8", "surrogatepass"))
                at = np.unique(np.linspace(0, len(c) - 1, min(most, len(c))).round().astype(np.int64))
                parts.append(np.ascontiguousarray(c[at]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), batch.column("label")], names=["chunks", "label"])
    return tidy(run)


def learn(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1), rows: int = SAMPLE_ROWS,
          most: int = SAMPLE_CHUNKS, id_col: str = "doc_id", text_col: str = "text",
          label: str = "quality") -> Network:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, of any length; of
    each at most ``most`` chunks, which lie evenly over the whole text."""
    some = sample(docs, labels, label, fold, rows, id_col, text_col)
    got = some.mapInArrow(_sampled_chunks(most), "chunks binary, label int").collect()      # rows * most chunks
    got = sorted((bytes(r["chunks"]), r["label"]) for r in got)
    return train_on_chunks([np.frombuffer(c, np.int16).reshape(-1, CHUNK) for c, _ in got], [k for _, k in got])


def _scores(net: Network):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start, size, out = 0, 0, []
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= 1_000_000 or i + 1 == len(texts):
                    out.append(net.probabilities(texts[start:i + 1]))
                    start, size = i + 1, 0
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])
    return tidy(run)


def score_quality(docs: DataFrame, net: Network, fold: tuple[int, int] = (3, 1), id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    A null or empty text is one chunk of padding and gets that chunk's score; a very long one is
    scored over all its chunks. ``held_out`` is null for a null id. Repeated rows are scored
    each, an empty table gives no rows, further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_scores(net), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out("doc_id", *fold).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
