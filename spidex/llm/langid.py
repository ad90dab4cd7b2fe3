"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text is read whole, in segments of ``SEGMENT`` bytes that run side by side. Two recurrent layers of ``UNITS`` units, one from each
side, see each byte of a segment; every position gets a probability for each language, and a text's probabilities are the mean over
its positions. Training is backpropagation through time over the segments, with Adam, on the driver: from at most
``per_language`` labelled texts of each language (those of the smallest hashes of doc_id), ``per_text`` segments spread over the
whole text from each. The network has a few thousand numbers, whatever the corpus.

Gates and candidates use x / (1 + |x|), which keeps the range of tanh and costs a fifth of it.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a language without training texts isn't learned;
without any, every text is ``und``; of equal probabilities the first language in order is taken; scores are rounded to five digits, below
which equal texts may differ by what is read beside them; a text of any length is read whole, in batches of segments; rows with a null doc_id count as not held out and aren't trained
on; an empty table gives an empty result. Only ``text`` is an input of a prediction.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spidex.llm.common import shuffle_partitions, text_or_empty

SEGMENT, UNITS, SIDE = 64, 8, 512


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def segments(text: bytes) -> tuple[np.ndarray, int]:
    """(segments, SEGMENT) bytes, the last filled with zeros, and the text's length."""
    rows = -(-len(text) // SEGMENT)
    out = np.zeros(rows * SEGMENT, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, SEGMENT), len(text)


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _layer(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: bool = False):
    """States after each step of x (steps, side); table (256, 3 units) is what a byte adds to gates and candidate."""
    steps, side = x.shape
    n = u.shape[0]
    h, hs, tape = np.zeros((side, n), np.float32), np.empty((steps, side, n), np.float32), []
    for t in range(steps):
        a, b = table[x[t]], h @ u
        a[:, : 2 * n] += b[:, : 2 * n]
        gates = _soft(a[:, : 2 * n]) * np.float32(0.5) + np.float32(0.5)
        z, r = gates[:, :n], gates[:, n:]
        c = _soft(a[:, 2 * n :] + r * b[:, 2 * n :])
        new = h + z * (c - h)
        if keep:
            tape.append((h, z, r, c, b[:, 2 * n :]))
        hs[t] = h = new
    return hs, tape


def _layer_back(x, u, tape, dhs):
    """Gradients of the table and u, from those of all states."""
    n, dh = u.shape[0], np.zeros_like(dhs[0])
    into, through, before = [], [], []
    for t in reversed(range(len(tape))):
        h, z, r, c, m = tape[t]
        dh = dh + dhs[t]
        dz, dc = dh * (c - h), dh * z
        dac = dc * (1 - np.abs(c)) ** 2
        daz = dz * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dar = dac * m * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        back = np.concatenate([daz, dar, dac * r], axis=1)
        into.append(np.concatenate([daz, dar, dac], axis=1))
        through.append(back)
        before.append(h)
        dh = dh * (1 - z) + back @ u.T
    flat, at = np.concatenate(into[::-1]), x.ravel()
    table = np.stack([np.bincount(at, weights=flat[:, k], minlength=256) for k in range(flat.shape[1])], axis=1)
    return table, np.concatenate(before).T @ np.concatenate(through)


class Network:
    def __init__(self, languages: list[str], seed: int = 7, units: int = UNITS):
        rng = np.random.default_rng(seed)
        self.languages, k = languages, len(languages)
        shape = {"tf": (256, 3 * units), "tb": (256, 3 * units), "uf": (units, 3 * units), "ub": (units, 3 * units), "v": (2 * units, k), "b": (k,)}
        self.p = {name: (rng.standard_normal(s) * (0.5 if name[0] == "t" else 0.3)).astype(np.float32) for name, s in shape.items()}

    def forward(self, x: np.ndarray, keep: bool = False):
        """x (steps, side) -> probabilities (steps, side, languages)."""
        p = self.p
        f, tape_f = _layer(x, p["tf"], p["uf"], keep)
        b, tape_b = _layer(x[::-1], p["tb"], p["ub"], keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        logits = both @ p["v"] + p["b"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), (both, tape_f, tape_b)

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray):
        """Loss and gradients of the mean cross entropy over real positions; y (side,) is each segment's language."""
        q, (both, tape_f, tape_b) = self.forward(x, keep=True)
        n, units = max(1, int(real.sum())), self.p["uf"].shape[0]
        at = np.broadcast_to(y, real.shape)[..., None]
        loss = float(-(np.log(np.take_along_axis(q, at, 2)[..., 0] + 1e-9) * real).sum() / n)
        d = q.copy()
        np.put_along_axis(d, at, np.take_along_axis(d, at, 2) - 1, 2)
        d *= (real / n)[..., None].astype(np.float32)
        flat = d.reshape(-1, d.shape[2])
        g = {"v": both.reshape(-1, both.shape[2]).T @ flat, "b": flat.sum(axis=0)}
        dboth = d @ self.p["v"].T
        g["tf"], g["uf"] = _layer_back(x, self.p["uf"], tape_f, dboth[:, :, :units])
        g["tb"], g["ub"] = _layer_back(x[::-1], self.p["ub"], tape_b, dboth[::-1, :, units:])
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, steps: int = 400, side: int = 256, rate: float = 0.02, seed: int = 11) -> "Network":
        """x (segments, SEGMENT), y the language of each, lengths the real bytes of each."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), side)
            real = np.arange(SEGMENT)[:, None] < lengths[pick][None, :]
            _, g = self.gradients(x[pick].T, y[pick], real)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean probability over all positions of each text; no bytes: zeros."""
        parts = [segments(t) for t in texts]
        rows = np.array([len(s) for s, _ in parts])
        out = np.zeros((len(texts), len(self.languages)))
        if not rows.sum():
            return out
        x = np.concatenate([s for s, _ in parts])
        of = np.repeat(np.arange(len(texts)), rows)
        real = np.full(len(x), SEGMENT)
        ends = np.cumsum(rows) - 1
        some = rows > 0
        real[ends[some]] = [n - (k - 1) * SEGMENT for k, (_, n) in zip(rows[some], [p for p in parts if p[1]])]
        for a in range(0, len(x), SIDE):
            q, _ = self.forward(np.ascontiguousarray(x[a : a + SIDE].T))
            mask = np.arange(SEGMENT)[:, None] < real[None, a : a + SIDE]
            sums = np.einsum("tsk,ts->sk", q, mask.astype(np.float32))
            np.add.at(out, of[a : a + SIDE], sums)
        return np.round(out / np.maximum(1, [[n] for _, n in parts]), 5)


def training_segments(docs: DataFrame, per_language: int, per_text: int, most_languages: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text")).filter("doc_id is not null and lang is not null and text <> ''").filter(~held_out())
    # both windows drop all but per_language rows a language within each task before they shuffle; the first, over groups of
    # tasks, leaves the second as many rows as there are groups, however many tasks read the table
    groups = math.isqrt(shuffle_partitions(docs.sparkSession)) + 1
    chosen = usable.select("doc_id", "lang", (F.spark_partition_id() % groups).alias("group"))
    for keys in (["lang", "group"], ["lang"]):
        first = W.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = chosen.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= per_language).drop("nth")

    def run(batches_):
        for batch in batches_:
            langs, data, sizes = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, n = segments(text.encode())
                for k in np.unique(np.linspace(0, len(x) - 1, per_text).astype(int)).tolist():
                    langs.append(lang)
                    data.append(x[k].tobytes())
                    sizes.append(min(SEGMENT, n - k * SEGMENT))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary()), pa.array(sizes, pa.int32())], names=["lang", "data", "size"])

    # a network has a bounded number of outputs: the languages with the most texts, where there are more of them
    common = chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).select("lang")
    chosen = chosen.join(F.broadcast(common), "lang", "left_semi")
    # per_language ids for each of most_languages, no more
    rows = usable.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("lang", "text").mapInArrow(run, "lang string, data binary, size int").orderBy("lang", "data", "size").toArrow()
    langs = rows["lang"].to_pylist()
    languages = sorted(set(langs))
    x = np.frombuffer(b"".join(rows["data"].to_pylist()), np.uint8).reshape(-1, SEGMENT)
    return x, np.array([languages.index(v) for v in langs], np.int64), rows["size"].to_numpy().astype(np.int64), languages


def learn(docs: DataFrame, per_language: int = 400, per_text: int = 12, steps: int = 400) -> Network | None:
    """Trained on rows of ``docs`` that aren't held out; None without any."""
    x, y, lengths, languages = training_segments(docs, per_language, per_text)
    return Network(languages).train(x, y, lengths, steps) if languages else None


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches_):
        net = shared.value
        for batch in batches_:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                texts = part.column(1).to_pylist()
                lettered = np.array([net is not None and any(map(str.isalpha, t)) for t in texts])
                q = net.documents([t.encode() if ok else b"" for t, ok in zip(texts, lettered)]) if net is not None else np.zeros((len(texts), 1))
                best, score = q.argmax(axis=1), np.clip(q.max(axis=1), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([net.languages[k] if ok else "und" for k, ok in zip(best, lettered)], pa.string()), pa.array(np.where(lettered, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    return predict(docs, learn(docs, **how)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
