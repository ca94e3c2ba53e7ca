"""Language identification with a bidirectional gated recurrent network over bytes.

Each byte of a text is read in windows of ``WINDOW`` bytes by two minimal gated units, one from each
side.  Every position gets a label distribution from both states; a document's distribution is the
mean over all its positions, so the whole text counts.  Gates use x / (1 + |x|), which is several
times cheaper than tanh.  The network is trained in numpy by backpropagation through time on a
bounded, hash-ordered sample of windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spark_rca.llm.common import free_names, lean

WINDOW, HIDDEN = 128, 8
#: Bound of the training sample: documents, and windows of each.
SAMPLE_DOCS, DOC_WINDOWS = 4000, 3


class ByteGru:
    """Two minimal gated units of ``HIDDEN`` states and a softmax over ``labels`` at every byte."""

    def __init__(self, labels: list[str], seed: int = 1):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.labels = labels
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.5, (256, 2 * h))
            self.p[f"U{d}"] = rng.normal(0, 0.5 / h**0.5, (h, h))
            self.p[f"V{d}"] = rng.normal(0, 0.5 / h**0.5, (h, h))
            self.p[f"O{d}"] = rng.normal(0, 0.5, (len(labels), h))
            self.p[f"g{d}"] = np.full((h, 1), -1.0)
        self.p["o"] = np.zeros((len(labels), 1))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _scan(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Label scores (time, labels, windows) of one direction; ``keep`` gets what the gradient needs."""
        p, h = self.p, HIDDEN
        w, u, v, o, bias = p[f"W{d}"], p[f"U{d}"], p[f"V{d}"], p[f"O{d}"], p[f"g{d}"]
        n = x.shape[1]
        s = np.zeros((h, n), np.float32)
        out = np.empty((len(x), len(o), n), np.float32)
        g, c, t = (np.empty((h, n), np.float32) for _ in range(3))
        xin = np.empty((n, 2 * h), np.float32)
        for i in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(w, x[i], axis=0, out=xin, mode="clip")
            xt = xin.T
            np.matmul(u, s, out=g)
            g += xt[:h]
            g += bias
            if keep is not None:
                g_in = g.copy()
            np.abs(g, out=t)
            t += 1
            g /= t
            g *= 0.5
            g += 0.5
            np.multiply(g, s, out=t)
            np.matmul(v, t, out=c)
            c += xt[h:]
            if keep is not None:
                keep.append((i, s.copy(), g_in, g.copy(), c.copy()))
            np.abs(c, out=t)
            t += 1
            c /= t
            c -= s
            c *= g
            s += c
            np.matmul(o, s, out=out[i])
            if keep is not None:
                keep[-1] += (s.copy(),)
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (time, labels, windows) of byte windows (time, windows)."""
        z = self._scan(x, "f")
        z += self._scan(x, "b")
        z += self.p["o"]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients: cross-entropy at every unmasked position, by backpropagation through time."""
        keeps = {"f": [], "b": []}
        z = self._scan(x, "f", keeps["f"]) + self._scan(x, "b", keeps["b"]) + self.p["o"]
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        e /= e.sum(1, keepdims=True)
        cols = np.arange(x.shape[1])
        loss = float(-(np.log(e[:, y, cols] + 1e-9) * mask).sum() / mask.sum())
        dz = e
        dz[:, y, cols] -= 1
        dz *= (mask / mask.sum())[:, None, :]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["o"] = dz.sum((0, 2))[:, None]
        h = HIDDEN
        for d in "fb":
            u, v, o = self.p[f"U{d}"], self.p[f"V{d}"], self.p[f"O{d}"]
            ds = np.zeros((h, x.shape[1]), np.float32)
            for i, s0, g_in, g, c_in, s1 in reversed(keeps[d]):
                grad[f"O{d}"] += dz[i] @ s1.T
                ds = ds + o.T @ dz[i]
                size = 1 + np.abs(c_in)
                c = c_in / size
                dc = ds * g / (size * size)
                dt = v.T @ dc
                dg = (ds * (c - s0) + dt * s0) * 0.5 / (1 + np.abs(g_in)) ** 2
                grad[f"V{d}"] += dc @ (g * s0).T
                grad[f"U{d}"] += dg @ s0.T
                grad[f"g{d}"] += dg.sum(1, keepdims=True)
                np.add.at(grad[f"W{d}"], x[i], np.concatenate([dg, dc]).T)
                ds = ds * (1 - g) + dt * g + u.T @ dg
        return loss, grad

    def train(self, windows: np.ndarray, y: np.ndarray, length: np.ndarray, steps: int = 260, batch: int = 192, rate: float = 0.02, seed: int = 2) -> float:
        """Adam over random batches of windows (n, WINDOW), zero after ``length``; classes are drawn evenly."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        loss = 0.0
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, max(1, batch // len(by))) for b in by if len(b)])
            cut = np.minimum(length[pick], np.where(rng.random(len(pick)) < 0.3, rng.integers(8, WINDOW + 1, len(pick)), WINDOW))
            mask = (np.arange(WINDOW)[:, None] < cut).astype(np.float32)
            x = np.where(mask > 0, windows[pick].T, 0).astype(np.uint8)
            loss, grad = self.gradient(x, y[pick], mask)
            lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            size = float(np.sqrt(sum(float((g * g).sum()) for g in grad.values())))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return loss

    def documents(self, data: np.ndarray, offs: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """Mean label probabilities (documents, labels) of texts in one buffer; empty texts get zeros."""
        size = np.diff(offs)
        per = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), per)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        n = size[doc]
        # The last window of a text ends with the text; its positions count once.
        start = np.where(n >= WINDOW, np.minimum(k * WINDOW, n - WINDOW), 0)
        skip = k * WINDOW - start
        out = np.zeros((len(size), len(self.labels)))
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        at = np.arange(WINDOW)[:, None]
        for a in range(0, len(doc), chunk):
            w = slice(a, a + chunk)
            mask = (at >= skip[w]) & (at < n[w] - start[w])
            x = padded[offs[doc[w]] + start[w] + at]
            x[at >= n[w] - start[w]] = 0
            prob = np.einsum("tkn,tn->nk", self.positions(x), mask.astype(np.float32))
            np.add.at(out, doc[w], prob)
        return out / np.maximum(size, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample_windows(labelled: DataFrame, docs: int = SAMPLE_DOCS, per_doc: int = DOC_WINDOWS) -> list:
    """At most ``docs`` * ``per_doc`` rows (label, window), from places all over the texts, chosen by hash."""
    wide = WINDOW + WINDOW // 2  # code points; cut to WINDOW bytes on arrival
    s = labelled.where("label IS NOT NULL AND text IS NOT NULL").withColumn("_h", F.xxhash64("text", F.lit(7)))
    # The least hashes of distinct texts come first, as bare numbers; texts follow only for those.
    least = s.select("_h").distinct().orderBy("_h").limit(docs).agg(F.max("_h")).first()[0]
    if least is None:
        return []
    s = s.where(F.col("_h") <= least)
    n = F.char_length("text")
    place = lambda k: F.pmod(F.xxhash64("_h", F.lit(k)), F.greatest(n - WINDOW, F.lit(0)) + 1).cast("int") + 1
    cut = F.array(*[F.substring("text", place(k), F.lit(wide)) for k in range(per_doc)])
    # Copies of a text under one label count once; under several labels, as often.
    some = s.select("_h", "label", cut.alias("w")).groupBy("_h", "label").agg(F.first("w").alias("w"))
    return some.orderBy("_h", "label").limit(docs).select("label", F.explode("w").alias("w")).collect()


def train_language_model(labelled: DataFrame) -> ByteGru | None:
    """A network from rows (text, label); None if there is no labelled text."""
    rows = [(r["label"], r["w"].encode()[:WINDOW]) for r in sample_windows(labelled)]
    rows = [r for r in rows if r[1].strip()]
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (_, w) in enumerate(rows):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    net = ByteGru(labels)
    net.train(x, np.array([labels.index(r[0]) for r in rows]), np.array([len(r[1]) for r in rows]))
    return net


def predict_language(spark: SparkSession, docs: DataFrame, net: ByteGru | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if there is
    no network.  Rows are independent: repeated rows get the same, an empty table gives an empty one, other
    columns stay as they are (``lang_pred`` and ``score`` are replaced).  The network (a few kB) is
    broadcast; documents are not shuffled.
    """
    cols = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(cols)
    (letters,) = free_names(docs, "letters")
    model = spark.sparkContext.broadcast(net)
    marked = docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(net is not None))
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")

    def run(it):
        from spark_rca.llm.bytehash import batches

        for b in it:
            t = pa.Table.from_batches([b])
            pred = np.full(len(t), "und", object)
            score = np.zeros(len(t))
            on = np.flatnonzero(t[letters].to_numpy(zero_copy_only=False))
            if len(on):
                text = t["text"].take(pa.array(on)).combine_chunks()
                for row, data, offs in batches(text):
                    prob = model.value.documents(data, offs)
                    best = prob.argmax(1)
                    at = on[row : row + len(best)]
                    pred[at] = [model.value.labels[k] for k in best]
                    score[at] = np.clip(prob[np.arange(len(best)), best], 0, 1)
            t = t.select(cols).append_column("lang_pred", pa.array(pred, pa.string())).append_column("score", pa.array(score))
            yield from t.to_batches()

    return marked.mapInArrow(lean(run), schema)


def labelled(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"))).select("text", F.col("lang").alias("label"))


def language_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    net = train_language_model(labelled(docs))
    out = predict_language(spark, docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Pipeline stage: documents go that have no letter, or whose best language scores below ``min_score``."""
    net = train_language_model(labelled(docs))
    return predict_language(spark, docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(docs.columns)
