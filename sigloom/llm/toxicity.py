"""Toxicity by a chain of linear classifiers.

The categories are predicted in turn; each model sees which of the training vocabulary's features a
text has (its words, and the first ``STEM`` letters of longer ones, so that endings it has not met
don't hide a word) and the probabilities of all earlier categories. In training those probabilities are
out-of-fold predictions, so a later model learns from what an earlier one says of texts it has not
seen. The models are fitted on a bounded sample of labelled rows (``SAMPLE``), chosen by a hash of
the id; scoring reads every text whole, in Arrow batches, and shuffles nothing.

Null and empty texts get the models' intercepts. Null labels and labels of unknown documents are
left out of training; if a category has no labels of both kinds its model is the smoothed share.
An empty table gives an empty result. Other columns pass through unless named like a result column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common

#: Labelled rows used for training, at most.
SAMPLE = 8_000
#: Words a model looks at, at most, and texts a word must be in.
VOCABULARY = 192
LEAST_TEXTS = 6
FOLDS = 3
RIDGE = 1.0
STEM = 4
TOXIC_AT = 0.5
#: The words by which a toxic text counts as an example of a category.
INSULT = ["idiot", "moron", "fool", "imbecile", "loser", "clown", "scum", "jerk", "pig", "rat", "coward", "liar", "creep", "freak", "bastard"]
CONTEMPT = ["stupid", "dumb", "pathetic", "worthless", "disgusting", "trash", "garbage", "useless", "ugly", "vile", "filthy", "disgrace", "hate", "shut", "despise"]


def features(text: str | None) -> set[str]:
    """The distinct words of a text, of any length, and the stems of the longer ones."""
    found = set(common.PLAIN_WORD.findall(text.lower())) if text else set()
    return found | {w[:STEM] + "*" for w in found if len(w) > STEM}


@dataclass
class Chain:
    """categories in order; words; weights [category, word], intercepts, and links [category, earlier category]."""

    categories: list[str]
    words: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    links: np.ndarray

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """From the summed word weights per text and category: the categories' probabilities, in turn."""
        out = np.zeros_like(sums)
        for k in range(len(self.categories)):
            out[:, k] = sigmoid(sums[:, k] + self.intercepts[k] + out[:, :k] @ self.links[k, :k])
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression by Newton steps, each halved until the penalised loss falls, so separable labels don't diverge; the last weight is the hardly penalised intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    share = (y.sum() + 1) / (len(y) + 10)  # of no labels: seldom
    w[-1] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return w

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + (penalty * w * w).sum() / 2

    now = loss(w)
    for _ in range(200):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        part = 1.0
        while (then := loss(w - part * step)) > now + 1e-12 * (1 + abs(now)) and part > 1e-9:
            part /= 2
        w, now = w - part * step, then
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, seeds: dict[str, list[str]], limit: int) -> DataFrame:
    """(key, words, y): features and category labels of at most ``limit`` labelled texts; texts with the same features count once.

    The first labels say whether a labelled-toxic text has a seed word of the category, the last is the label itself.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "__id").select("text", "__label")
    wanted = [set(s) for s in seeds.values()]

    def measure(texts: list, marks: list) -> list:
        found = [features(t) for t in texts]
        return [[sorted(f) for f in found], [[int(y and not s.isdisjoint(f)) for s in wanted] + [y] for f, y in zip(found, marks, strict=True)]]

    made = common.append_columns(rows, ["text", "__label"], "words array<string>, y array<int>", measure).select(F.xxhash64("words", "y").alias("key"), "words", "y")
    return common.materialise(made.dropDuplicates(["key"]), "labelled-texts")


def choose_words(rows: DataFrame, n: int, positives: list[int], limit: int) -> list[str]:
    """The features whose share among a category's texts differs most from their share elsewhere, in standard errors."""
    seen = rows.select(F.explode("words").alias("word"), "y").groupBy("word").agg(F.count("*").alias("df"), *[F.sum(F.col("y")[k]).alias(f"h{k}") for k in range(len(positives))])
    p = (F.col("df") + 1) / F.lit(n + 2.0)
    scores = [F.lit(0.0)]
    for k, m in enumerate(positives):
        if 0 < m < n:
            hits = F.col(f"h{k}")
            scores.append(F.abs(hits / m - (F.col("df") - hits) / (n - m)) / F.sqrt(p * (1 - p) * (1 / m + 1 / (n - m))))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    top = seen.where(F.col("df") >= LEAST_TEXTS).select("word", best.alias("score")).orderBy(F.desc("score"), "word").limit(limit)
    return sorted(r["word"] for r in top.collect())


def presence(rows: DataFrame, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``words`` each text has, as a 0/1 matrix, and its labels; a few bytes a text reach the driver."""
    index = {w: i for i, w in enumerate(words)}

    def bits(texts: list) -> list:
        out = np.zeros((len(texts), len(words)), bool)
        for i, ws in enumerate(texts):
            out[i, [index[w] for w in ws if w in index]] = True
        return [[row.tobytes() for row in np.packbits(out, axis=1)]]

    found = common.append_columns(rows, ["words"], "bits binary", bits).select("key", "bits", "y").orderBy("key").collect()
    x = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(words)) for r in found], float).reshape(len(found), len(words))
    return x, np.array([list(r["y"]) for r in found], float)


def train(x: np.ndarray, y: np.ndarray, words: list[str], categories: list[str], folds: int = FOLDS) -> Chain:
    """Fit the chain: a model per category, whose inputs are the features and the earlier models' out-of-fold probabilities."""
    n, k = len(x), len(categories)
    y = y.reshape(n, k)
    weights, intercepts, links, held_out = np.zeros((k, len(words))), np.zeros(k), np.zeros((k, k)), np.zeros((n, k))
    fold = np.arange(n) % folds
    for c in range(k):
        seen = np.hstack([x, held_out[:, :c]])
        w = fit_linear(seen, y[:, c])
        weights[c], links[c, :c], intercepts[c] = w[: len(words)], w[len(words) : -1], w[-1]
        for f in range(folds if n else 0):
            part = fit_linear(seen[fold != f], y[fold != f, c])
            held_out[fold == f, c] = sigmoid(np.hstack([seen, np.ones((n, 1))])[fold == f] @ part)
    return Chain(categories, words, weights, intercepts, links)


def classify(df: DataFrame, chain: Chain, text: str = "text", threshold: float = TOXIC_AT) -> DataFrame:
    """Add p_<category> for each category, and toxic: whether the last one's probability reaches the threshold."""
    model = df.sparkSession.sparkContext.broadcast((chain, {w: chain.weights[:, i] for i, w in enumerate(chain.words)}))

    def run(texts: list) -> list:
        chain, table = model.value
        sums, known = np.zeros((len(texts), len(chain.categories))), table.keys()
        for i, t in enumerate(texts):
            for w in known & features(t):
                sums[i] += table[w]
        p = chain.probabilities(sums)
        return [*(p[:, c] for c in range(p.shape[1])), p[:, -1] >= threshold]

    fields = ", ".join(f"p_{c} double" for c in chain.categories) + ", toxic boolean"
    return common.append_columns(df.withColumn(text, F.col(text).cast("string")), [text], fields, run)


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = SAMPLE) -> Chain:
    seeds = {"insult": INSULT, "contempt": CONTEMPT}
    categories = [*seeds, "toxic"]
    rows = sample(docs, labels, id_col, text, label, seeds, limit)
    total = rows.agg(F.count("*"), *[F.sum(F.col("y")[k]) for k in range(len(categories))]).first()
    words = choose_words(rows, int(total[0]), [int(t or 0) for t in total[1:]], VOCABULARY)
    return train(*presence(rows, words), words, categories)


def drop_toxic(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The rows that aren't toxic, with their own columns."""
    names = {c: f"__own_{i}" for i, c in enumerate(df.columns)}
    own = df.select(*[df[c].alias(n) for c, n in names.items()])
    return classify(own, chain, names[text]).where("not toxic").select(*[F.col(n).alias(c) for c, n in names.items()])
