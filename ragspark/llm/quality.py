"""Quality classifier: text evidence combined with host and path posteriors by empirical Bayes.

1. A logistic regression over the shape of a text (bytes it uses, length and repetition of its words) is
   fitted in numpy on a bounded sample of labelled rows and applied to every whole text.
2. The evidence of all documents is summed by host and by path within the host. The spread of the
   group means beyond chance gives the strength of the prior (method of moments), so a sparse path
   shrinks to its host and a sparse host to the corpus.
3. A document's result is the product of its own likelihood ratio and the odds of its site, where its
   own evidence is taken out of the site's sums first.

Null, empty and blank texts carry no evidence: they get quality 0, are rejected and do not count for their
site. A null host or path is a group of its own (the empty name). Repeated rows each count. Without any
labelled row of both classes the evidence is the neutral 0.5 and everything with text is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import map_texts, written
from ragspark.operators.hotkeys import salted_join

#: Bound of the fitting sample: labelled rows taken, by hash of the id.
MAX_LABELLED = 8000
#: Documents below this quality are rejected.
THRESHOLD = 0.5

_SHAPES = 128 + 8
_FLOOR = 1e-3


def shape(text: str) -> np.ndarray:
    """Log shares of each ASCII character and measures of its words, for a text that is not blank."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    kinds = len(set(words))
    again = sum(map(eq, words, words[1:]))
    again_at_two = sum(map(eq, words, words[2:]))
    return np.concatenate(
        [
            np.log(_FLOOR + counts[:128] / size),
            np.log(
                _FLOOR
                + np.array(
                    [
                        counts[128:].sum() / size,
                        counts[65:91].sum() / size,
                        counts[48:58].sum() / size,
                        kinds / n,
                        again / n,
                        again_at_two / n,
                        size / n / 10,
                        n / 100,
                    ]
                )
            ),
        ]
    )


@dataclass
class ShapeModel:
    """Standardised logistic regression; without weights it is neutral."""

    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    offset: float = 0.0
    share: float = 0.5

    @classmethod
    def fit(cls, shapes: np.ndarray, good: np.ndarray, ridge: float = 3.0) -> ShapeModel:
        """Newton's method with a ridge on the weights."""
        if not len(good) or good.min() == good.max():
            return cls()
        centre, scale = shapes.mean(axis=0), shapes.std(axis=0) + 1e-6
        x = np.column_stack([(shapes - centre) / scale, np.ones(len(shapes))])
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 0
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (good - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(centre, scale, w[:-1], float(w[-1]), float(good.mean()))

    def chance(self, shapes: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(shapes), 0.5)
        # a shape far outside the sample is no stronger evidence than one at its edge
        x = np.clip((shapes - self.centre) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.offset, -12, 12)))


def _shapes(texts: list) -> dict[str, pa.Array]:
    rows = [shape(t).tolist() if t and not t.isspace() else None for t in texts]
    return {"shape": pa.array(rows, pa.list_(pa.float64()))}


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> ShapeModel:
    """Fit on at most ``max_labelled`` labelled ids, the first by hash; a label above 0 is good, null labels are left out.

    An id counts once, with its smallest text that is not null, however many rows have it.
    """
    rated = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.max(F.col(label).cast("double")).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
        .collect()
    )
    good = {r["doc_id"]: float(r["good"] > 0) for r in rated}
    if not good:
        return ShapeModel()
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isin(list(good)))
    sample = named.groupBy("doc_id").agg(F.min("text").alias("text"))
    got = map_texts(sample, "text", lambda: _shapes, "shape array<double>").filter("shape is not null").orderBy("doc_id").toArrow()
    if not got.num_rows:
        return ShapeModel()
    shapes = got.column("shape").combine_chunks().values.to_numpy().reshape(-1, _SHAPES)
    return ShapeModel.fit(shapes, np.array([good[i] for i in got.column("doc_id").to_pylist()]))


def evidence(docs: DataFrame, model: ShapeModel, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``p_doc``, null where there is nothing to judge."""

    def judge(texts: list) -> dict[str, pa.Array]:
        out = np.full(len(texts), np.nan)
        held = [i for i, t in enumerate(texts) if t and not t.isspace()]
        if held:
            out[held] = model.chance(np.array([shape(texts[i]) for i in held]))
        return {"p_doc": pa.array(out, pa.float64(), from_pandas=True)}

    return map_texts(docs, text, lambda: judge, "p_doc double")


def _strength(row, mean: float) -> float:
    """Pseudo-counts of a prior with that mean, from group sums: spread of the means beyond that of their rows."""
    if not row["n"] or row["groups"] < 2:
        return 1e6
    inside = max(row["inside"], 0.0) / max(row["n"] - row["groups"], 1)
    between = (row["outside"] - (row["groups"] - 1) * inside) / max(row["n"] - row["squares"] / row["n"], 1e-9)
    if between <= 1e-9:
        return 1e6
    return float(min(max(mean * (1 - mean) / between - 1, 1.0), 1e6))


def _spread(groups: DataFrame, mean: F.Column):
    own = F.col("s") / F.col("n")
    return groups.agg(
        F.sum("n").cast("double").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n") * F.col("n").cast("double")).alias("squares"),
        F.sum(F.col("s2") - F.col("s") * own).alias("inside"),
        F.sum(F.col("n") * (own - mean) * (own - mean)).alias("outside"),
        F.sum("s").alias("s"),
    ).collect()[0]


def _logit(p: F.Column) -> F.Column:
    held = F.least(F.greatest(p, F.lit(1e-5)), F.lit(1 - 1e-5))
    return F.log(held / (1 - held))


def posteriors(judged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Combine ``p_doc`` of rows with the posteriors of their ``host`` and ``path``.

    ``judged`` is read several times and should be a written table. Adds ``site_prior`` (the posterior of
    the path without the row itself), ``quality`` and ``keep``.
    """
    rows = judged.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    sums = [F.count("p_doc").alias("n"), F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("s2")]
    paths = rows.groupBy("host", "path").agg(*sums).filter("n > 0")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()[0]
    if not total["n"]:
        nothing = F.lit(None).cast("double")
        return rows.withColumns({"site_prior": nothing, "quality": F.lit(0.0), "keep": F.lit(False)})
    mean = total["s"] / total["n"]
    of_hosts = _strength(_spread(hosts, F.lit(mean)), mean)
    within = paths.join(hosts.select("host", (F.col("s") / F.col("n")).alias("host_mean")), "host")
    of_paths = _strength(_spread(within, F.col("host_mean")), mean)

    site = paths.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s")).join(
        hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host"
    )
    own = F.coalesce("p_doc", F.lit(0.0))
    one = F.col("p_doc").isNotNull().cast("int")
    less = lambda name, part: F.greatest(F.coalesce(name, F.lit(0)) - part, F.lit(0))
    host = (less("host_s", own) + of_hosts * mean) / (less("host_n", one) + of_hosts)
    prior = (less("path_s", own) + of_paths * host) / (less("path_n", one) + of_paths)
    odds = _logit(F.col("p_doc")) + _logit(F.col("site_prior")) - _logit(F.lit(mean))
    return (
        # one path may hold a third of all rows
        salted_join(rows, site, ["host", "path"], "left", F.xxhash64("doc_id", "p_doc"))
        .withColumn("site_prior", prior)
        .withColumn("quality", F.when(F.col("p_doc").isNull(), F.lit(0.0)).otherwise(1 / (1 + F.exp(-odds))))
        .withColumn("keep", F.col("quality") >= threshold)
        .drop("path_n", "path_s", "host_n", "host_s")
    )


def classify(
    docs: DataFrame,
    model: ShapeModel,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, host, path, p_doc, site_prior, quality, keep`` of each row of ``docs``."""
    chosen = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"),
        F.col(text).alias("text"),
    )
    return posteriors(written(evidence(chosen, model), "evidence"), threshold)
