"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. The rules' accuracies and the share of good
documents are estimated by expectation-maximisation over the counts of vote patterns of the whole
corpus (at most 3 to the number of rules, whatever the number of documents), and the posterior
probability that a document is good replaces the demand that every rule pass.

Null and empty texts have no words and fail the base check. Very long texts are read whole.
Repeated rows are judged alike; an empty table gives an empty result. Other columns pass through
unless named like a result column.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common

GOOD, BAD, ABSTAIN = 1, 0, 2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents with at least this posterior are kept.
KEEP_AT = 0.5
_SYMBOL = re.compile(r"[#*$%&|<>]")
_LETTERS = re.compile(r"[^\W\d_]+")
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_lines", "n_letters", "n_runs", "n_capitals"]


def measure(text: str | None) -> list[int]:
    """The counts of _COUNTS and _MORE for one text."""
    text = text or ""
    words = text.encode().split()  # bytes: only ASCII white space splits
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if common.WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    times = Counter(windows)
    if len(times) < len(windows):
        end = 0  # words before this place are counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    runs = _LETTERS.findall(text)
    return [len(words), word_chars, len(_SYMBOL.findall(text)), dup, repeat, lines, sum(map(len, runs)), len(runs), sum(r.isupper() for r in runs if len(r) > 1)]


def band(x: float, good: Callable[[float], bool], bad: Callable[[float], bool]) -> int:
    return GOOD if good(x) else BAD if bad(x) else ABSTAIN


#: A rule maps the counts to a vote; between its two bounds it abstains.
RULES: dict[str, Callable[[dict], int]] = {
    "length": lambda c: band(c["n_words"], lambda x: x >= 80, lambda x: x < 20),
    "word_length": lambda c: band(c["word_chars"] / max(1, c["n_words"]), lambda x: 3 <= x <= 9, lambda x: x < 2.2 or x > 13),
    "symbols": lambda c: band(c["n_symbols"] / max(1, c["n_words"]), lambda x: x <= 0.02, lambda x: x > 0.1),
    "repeated_lines": lambda c: band(c["n_dup_lines"] / max(1, c["n_lines"]), lambda x: x <= 0.05, lambda x: x > 0.3),
    "repeated_words": lambda c: band(c["n_repeat_words"] / max(1, c["n_words"]), lambda x: x <= 0.15, lambda x: x > 0.4),
    "letters": lambda c: band(c["n_letters"] / max(1, c["word_chars"]), lambda x: x >= 0.9, lambda x: x < 0.6),
    "capitals": lambda c: band(c["n_capitals"] / max(1, c["n_runs"]), lambda x: x <= 0.1, lambda x: x > 0.3),
}


def with_votes(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ``votes``: the rules' votes as the digits of a number to base 3."""

    def run(texts: list) -> list:
        columns: list[list] = [[] for _ in range(len(_COUNTS) + 1)]
        for t in texts:
            got = measure(t)
            counts = dict(zip(_COUNTS + _MORE, got, strict=True))
            code = 0
            for rule in RULES.values():
                code = 3 * code + rule(counts)
            for c, v in zip(columns, [*got[: len(_COUNTS)], code], strict=True):
                c.append(v)
        return columns

    out = common.append_columns(df.withColumn(text, F.col(text).cast("string")), [text], ", ".join(f"{c} long" for c in _COUNTS) + ", votes int", run)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return common.without(out, ["base_failed"]).withColumn("base_failed", base)


def digits(codes: np.ndarray, rules: int) -> np.ndarray:
    return np.stack([codes // 3 ** (rules - 1 - i) % 3 for i in range(rules)], axis=1)


def estimate(codes: np.ndarray, counts: np.ndarray, rules: int = len(RULES), rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns. Returns each pattern's posterior of good, and P(vote | class) as [class, rule, vote].

    The start is the share of good votes among those cast, so the classes keep their meaning.
    A rule's votes are smoothed by a prior that believes it right more often than wrong.
    """
    votes, n = digits(codes, rules), counts.astype(float)
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    p = (good + 1) / (good + 2 * bad + 2)
    prior = np.zeros((2, 1, 3))
    prior[1, 0, [GOOD, BAD, ABSTAIN]] = 8, 1, 1
    prior[0, 0, [GOOD, BAD, ABSTAIN]] = 2, 4, 2
    given = np.zeros((2, rules, 3))
    for _ in range(rounds):
        for k, w in ((1, n * p), (0, n * (1 - p))):
            for v in range(3):
                given[k, :, v] = (w[:, None] * (votes == v)).sum(0)
        given = given + prior
        given /= given.sum(2, keepdims=True)
        share = (n @ p + 2) / (n.sum() + 4)
        log = [np.log(given[k, np.arange(rules), votes]).sum(1) + np.log(s) for k, s in ((0, 1 - share), (1, share))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            p = new
            break
        p = new
    return p, given


def posteriors(voted: DataFrame) -> DataFrame:
    """(votes, p_good): one row per vote pattern of the whole table, at most 3 to the number of rules."""
    spark = voted.sparkSession
    found = voted.groupBy("votes").count().orderBy("votes").collect()
    if not found:
        return spark.createDataFrame([], "votes int, p_good double")
    codes, counts = np.array([r[0] for r in found]), np.array([r[1] for r in found])
    p, _ = estimate(codes, counts)
    return spark.createDataFrame([(int(c), float(x)) for c, x in zip(codes, p, strict=True)], "votes int, p_good double")


def judge(voted: DataFrame, patterns: DataFrame) -> DataFrame:
    """Add p_good and kept to a table with votes."""
    out = common.without(voted, ["p_good", "kept"]).join(F.broadcast(patterns), "votes", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= KEEP_AT))


def score(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept, p_good and votes per row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    voted = common.materialise(with_votes(rows).drop("text"), "votes")
    return judge(voted, posteriors(voted)).select("doc_id", *_COUNTS, "base_failed", "kept", "p_good", "votes")


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns. Two passes over the texts and no shuffle of them."""
    patterns = posteriors(with_votes(df.select(F.col(text).alias("text"))))
    names = {c: f"__own_{i}" for i, c in enumerate(df.columns)}
    own = df.select(*[df[c].alias(n) for c, n in names.items()])
    kept = judge(with_votes(own, names[text]), patterns).where("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
