"""Toxicity categories with a chain of linear classifiers.

Terms are whole words and the first four and five letters of words (families of inflected words).
From a bounded, hash-ordered sample of labelled rows, term counts by label give each term's log odds;
the terms that clearly belong to toxic rows are the features.  The chain predicts ``toxic``, then
``low_quality``, then ``toxic_low_quality`` (both), all of them labels and no functions of the text.
Each later model also sees the earlier categories' probabilities.  Training is out of fold twice: a
row's features come from terms and odds that its fold had no part in, and so do the probabilities that
later models learn from, so these meet them as uncertain as they will be on new texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spark_rca.llm.common import free_names, lean, materialize, small_side

CATEGORIES = ["toxic", "low_quality", "toxic_low_quality"]
#: The most labelled rows that are learned from.
SAMPLE_ROWS = 12_000
MIN_ROWS, MIN_ODDS, FOLDS = 4, 2.5, 5


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(row, text, toxic, low, fold): labelled rows in hash order.

    A document labelled twice is toxic, or of low quality, if any label says so; a quality of null says nothing.
    """
    low = F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0)) if "quality" in labels.columns else F.lit(0)
    lab = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(low).alias("low"))
    lab = lab.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    hit = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").where("text IS NOT NULL")
    rows = hit.select(F.xxhash64("doc_id", "text").alias("row"), "text", F.col("toxic").cast("int").alias("toxic"), "low").dropDuplicates(["row"])
    # Equal texts are in one fold.
    return rows.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(FOLDS)).cast("int"))


def _terms(df: DataFrame) -> DataFrame:
    """(row, toxic, fold, term, n): the distinct terms of each sampled row."""
    words = df.select("row", "toxic", "fold", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).where("length(w) > 2")
    kinds = F.array(F.col("w"), F.when(F.length("w") > 4, F.concat(F.substring("w", 1, 4), F.lit("*"))), F.when(F.length("w") > 5, F.concat(F.substring("w", 1, 5), F.lit("*"))))
    return words.select("row", "toxic", "fold", F.explode(kinds).alias("term")).where("term IS NOT NULL").groupBy("row", "toxic", "fold", "term").agg(F.count("*").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 25) -> np.ndarray:
    """Weights (last: intercept) by Newton's method in the smaller of the two dimensions of the data."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-2
    def loss(v):
        z = x1 @ v
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (reg * v * v).sum()

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + reg * w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(reg)
        step = np.linalg.solve(h, g)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-8:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _prob(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """Terms and one linear model for each category; ``features`` makes a row's inputs from its term counts."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.models: list[np.ndarray] = []

    def features(self, counts: dict[str, int]) -> np.ndarray:
        """Seven figures of a row's terms, each term counted once however often it occurs.

        Sum and largest of the odds of all terms, words and stems alike: a word whose stems are terms as well adds the odds of each.
        Then the number of distinct words and of distinct stems, the logs of how often each kind occurs, and whether there is any.
        """
        odds = [self.terms[t] for t in counts]
        words = [t for t in counts if not t.endswith("*")]
        stems = [t for t in counts if t.endswith("*")]
        return np.array([sum(odds), max(odds, default=0.0), len(words), len(stems), np.log1p(sum(counts[t] for t in words)), np.log1p(sum(counts[t] for t in stems)), float(bool(odds))])

    def fit(self, x: np.ndarray, targets: np.ndarray, fold: np.ndarray) -> None:
        seen = x
        for k in range(targets.shape[1]):
            y = targets[:, k].astype(float)
            self.models.append(_logistic(seen, y))
            out = np.zeros(len(x))
            for f in range(FOLDS):
                on = fold == f
                if on.any() and (~on).any():
                    out[on] = _prob(seen[on], _logistic(seen[~on], y[~on]))
            seen = np.column_stack([seen, out])

    def predict(self, x: np.ndarray) -> np.ndarray:
        seen, out = x, []
        for w in self.models:
            out.append(_prob(seen, w))
            seen = np.column_stack([seen, out[-1]])
        return np.column_stack(out) if out else np.zeros((len(x), 0))


def train_chain(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Chain | None:
    """None if the labelled rows are not of both kinds.  Chosen terms and their hits come from at most ``rows`` rows."""
    s = materialize(_sample(docs, labels, rows))
    total = {(r["fold"], r["toxic"]): r["count"] for r in s.groupBy("fold", "toxic").count().collect()}
    kinds = [sum(n for (_, y), n in total.items() if y == k) for k in (0, 1)]
    if not all(kinds):
        return None
    t = materialize(_terms(s))
    without = lambda f, c: F.sum(F.when(F.col("fold") != f, c).otherwise(0))
    folds = [-1, *range(FOLDS)]  # -1: all rows
    by = t.groupBy("term").agg(*[without(f, F.col("toxic")).alias(f"bad{f}") for f in folds], *[without(f, F.lit(1)).alias(f"rows{f}") for f in folds])
    odds = {}
    for f in folds:
        good, bad = (kinds[k] - (total.get((f, k), 0)) for k in (0, 1))
        value = F.log((F.col(f"bad{f}") + 0.5) / (bad + 1.0)) - F.log((F.col(f"rows{f}") - F.col(f"bad{f}") + 0.5) / (good + 1.0))
        odds[f] = F.when((F.col(f"bad{f}") >= MIN_ROWS) & (value >= MIN_ODDS), value)
    top = materialize(by.select("term", *[odds[f].alias(f"odds{f}") for f in folds]).where(" OR ".join(f"`odds{f}` IS NOT NULL" for f in folds)))
    chosen = top.collect()
    chains = {f: Chain({r["term"]: r[f"odds{f}"] for r in chosen if r[f"odds{f}"] is not None}) for f in folds}
    hits = t.join(small_side(top.select("term")), "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("counts"))
    got = s.select("row", "toxic", "low", "fold").join(hits, "row", "left").orderBy("row").collect()
    own = [chains[r["fold"]] for r in got]
    x = np.array([c.features({k: n for k, n in (r["counts"] or {}).items() if k in c.terms}) for c, r in zip(own, got, strict=True)])
    y, low = np.array([r["toxic"] for r in got]), np.array([r["low"] for r in got])
    chains[-1].fit(x, np.column_stack([y, low, y * low]), np.array([r["fold"] for r in got]))
    return chains[-1]


def predict_toxicity(spark: SparkSession, docs: DataFrame, chain: Chain | None) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category.

    Null and empty texts have the probabilities of a text without a toxic term, and 0 if nothing could be
    learned.  Rows are independent: repeated rows get the same, an empty table gives an empty one, other
    columns stay as they are (those called ``p_<category>`` are replaced).  The chain is broadcast.
    """
    model = spark.sparkContext.broadcast(chain)
    cols = [c for c in docs.columns if c not in {f"p_{k}" for k in CATEGORIES}]
    docs = docs.select(cols)
    (hits,) = free_names(docs, "hits")
    schema = StructType([*docs.schema.fields])
    for c in CATEGORIES:
        schema = schema.add(f"p_{c}", "double")
    if chain is None or not chain.terms:
        for c in CATEGORIES:
            docs = docs.withColumn(f"p_{c}", F.lit(0.0))
        return docs
    # Words that can hit: those in the vocabulary, or in one of its families.  Found inside the JVM.
    stems = sorted({t[:4].rstrip("*") for t in chain.terms})
    marked = docs.withColumn(hits, F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.substring(w, 1, 4).isin(stems)))

    def run(it):
        chain = model.value
        for b in it:
            t = pa.Table.from_batches([b])
            feats = []
            for words in t[hits].to_pylist():
                counts: dict[str, int] = {}
                for w in words:
                    for term in [w] + [f"{w[:k]}*" for k in (4, 5) if len(w) > k]:
                        if term in chain.terms:
                            counts[term] = counts.get(term, 0) + 1
                feats.append(chain.features(counts))
            p = chain.predict(np.array(feats).reshape(len(t), -1))
            t = t.select(cols)
            for k, c in enumerate(CATEGORIES):
                t = t.append_column(f"p_{c}", pa.array(p[:, k], pa.float64()))
            yield from t.to_batches()

    return marked.mapInArrow(lean(run), schema)


def toxicity_query(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability for each category, and ``toxic``: the first category's reaches ``threshold``."""
    out = predict_toxicity(spark, docs.select("doc_id", "text"), train_chain(docs, labels))
    return out.select("doc_id", *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") >= threshold).alias("toxic"))
