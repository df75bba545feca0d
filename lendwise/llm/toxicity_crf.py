"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, so tokens are labelled first: a token of a toxic document counts as toxic if one of its
features (the word, or its first letters) occurs in toxic documents significantly more often than in others. The chain
has two tags; a word's features give its log-odds of the toxic tag, and transitions favour runs. Forward-backward
marginals are summed up per document and calibrated by a logistic regression on the document labels.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import content_key, held_out, resident, small_batches, written

WORDS = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 5, 6)
BUCKETS = 1 << 18
TRAIN_ROWS = 20_000
WINDOW = 40
WINDOWS_PER_DOC = 6
CACHE_WORDS = 300_000
EVIDENCE = 15.0  # G-test statistic from which a feature marks tokens
EPOCHS = 80
TOXIC_FROM = 0.5


def word_features(word: str) -> list[str]:
    """The word (lower case) and its first letters."""
    return [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if len(word) > n)]


def _bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def evidence_features(docs: DataFrame) -> dict[str, float]:
    """Features whose document counts are significantly higher among toxic texts, from ``docs(text, toxic)``.

    Texts count once, whatever their copies; what reaches the driver are the marking features alone.
    """
    texts = docs.dropDuplicates(["k1", "k2"])
    totals = {int(r["toxic"]): r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            feature, toxic = [], []
            for text, label in zip(batch["text"], batch["toxic"]):
                own = {f for w in set(WORDS.findall(text.lower())) for f in word_features(w)}
                feature += own
                toxic += [label] * len(own)
            yield pd.DataFrame({"feature": feature, "toxic": toxic})

    counts = (
        texts.select("text", "toxic").mapInPandas(spread, "feature string, toxic int").groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .where(F.col("a") * n0 > 4 * F.col("b") * n1)
    )
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    total = a + b
    share = n1 / (n1 + n0)
    statistic = 2 * (
        a * F.log(a / (total * share)) + F.when(b > 0, b * F.log(b / (total * (1 - share)))).otherwise(0.0)
    )
    return {r["feature"]: r["g"] for r in counts.withColumn("g", statistic).where(F.col("g") >= EVIDENCE).collect()}


def token_marks(words: list[str], evidence: frozenset[str] | dict) -> np.ndarray:
    """1 for the words that a marking feature covers."""
    return np.array([any(f in evidence for f in word_features(w)) for w in words], dtype=np.int8)


@dataclass
class ToxicModel:
    """Weights per feature bucket, start log-odds, transition scores ``trans[from, to]`` and the calibration."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    calibration: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def unary(self, word: str) -> float:
        return self.bias + float(sum(self.weights[_bucket(f)] for f in word_features(word)))


def _chain(unary: np.ndarray, first: np.ndarray, trans: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Log-odds messages along chains laid end to end (``first`` marks their starts).

    The recursion forgets its past geometrically, so it is solved by sweeps over all positions at once: each sweep
    repeats only positions whose predecessor still moved, until none moves by more than the tolerance.
    """
    a, b, c, d = np.exp([trans[1, 1], trans[0, 1], trans[1, 0], trans[0, 0]])
    message = unary.copy()
    todo = np.nonzero(~first)[0]
    while len(todo):
        odds = np.exp(np.clip(message[todo - 1], -500, 500))
        new = unary[todo] + np.log((a * odds + b) / (c * odds + d))
        moved = np.abs(new - message[todo]) > tolerance
        message[todo] = new
        after = todo[moved] + 1
        after = after[after < len(unary)]
        todo = after[~first[after]]
    return message


def marginals(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of the toxic tag at every position of the chains laid end to end."""
    if not len(unary):
        return np.zeros(0)
    first = np.zeros(len(unary), dtype=bool)
    ends = np.cumsum(lengths)
    first[(ends - lengths)[lengths > 0]] = True
    forward = _chain(unary, first, trans)
    last = np.zeros(len(unary), dtype=bool)
    last[ends[lengths > 0] - 1] = True
    backward = _chain(unary[::-1], last[::-1], trans.T)[::-1]  # includes the own unary
    return 1.0 / (1.0 + np.exp(-np.clip(forward + backward - unary, -500, 500)))


def _log_likelihood_step(unary: np.ndarray, tags: np.ndarray, trans: np.ndarray):
    """Gradients of a batch of equal windows: by unary score and by transition (exact, by forward-backward).

    Messages are kept as probabilities, scaled to sum to one at every step."""
    n, steps = unary.shape
    toxic = 1.0 / (1.0 + np.exp(-np.clip(unary, -30, 30)))
    local = np.stack([1.0 - toxic, toxic])  # tag, window, step
    hop = np.exp(np.clip(trans, -30, 30))
    alpha, beta = np.empty((2, steps, n)), np.empty((2, steps, n))
    alpha[:, 0] = local[:, :, 0]
    for t in range(1, steps):
        now = (hop.T @ alpha[:, t - 1]) * local[:, :, t]
        alpha[:, t] = now / now.sum(axis=0)
    beta[:, -1] = 0.5
    for t in range(steps - 2, -1, -1):
        now = hop @ (beta[:, t + 1] * local[:, :, t + 1])
        beta[:, t] = now / now.sum(axis=0)
    both = alpha * beta
    marginal = (both[1] / both.sum(axis=0)).T
    ahead = beta[:, 1:] * local.transpose(0, 2, 1)[:, 1:]
    pair = alpha[:, None, :-1] * hop[:, :, None, None] * ahead[None]
    pair /= pair.sum(axis=(0, 1))
    seen = np.array([[((tags[:, :-1] == i) & (tags[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
    return tags - marginal, seen - pair.sum(axis=(2, 3))


def fit_crf(windows: list[list[str]], tags: np.ndarray, epochs: int = EPOCHS, penalty: float = 1e-4):
    """Weights, bias and transitions that maximise the penalised log-likelihood (full batches, Adam)."""
    vocabulary = sorted({w for window in windows for w in window})
    place = {w: i for i, w in enumerate(vocabulary)}
    tokens = np.array([[place[w] for w in window] for window in windows])
    lists = [sorted({_bucket(f) for f in word_features(w)}) for w in vocabulary]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    names, column = np.unique(np.concatenate(lists), return_inverse=True)
    theta = np.zeros(len(names) + 1 + 4)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        weights, bias, trans = theta[: len(names)], theta[len(names)], theta[-4:].reshape(2, 2)
        per_word = bias + np.bincount(owner, weights[column], len(vocabulary))
        by_unary, by_trans = _log_likelihood_step(per_word[tokens], tags, trans)
        per_word_gradient = np.bincount(tokens.ravel(), by_unary.ravel(), len(vocabulary))
        gradient = np.concatenate(
            [np.bincount(column, per_word_gradient[owner], len(names)), [by_unary.sum()], by_trans.ravel()]
        ) / len(windows) - penalty * theta
        mean = 0.9 * mean + 0.1 * gradient
        var = 0.99 * var + 0.01 * gradient**2
        theta = theta + 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    full = np.zeros(BUCKETS)
    full[names] = theta[: len(names)]
    return full, float(theta[len(names)]), theta[-4:].reshape(2, 2)


def document_features(p: np.ndarray) -> tuple[float, float, float, float]:
    """A document's marginals summed up: the largest as log-odds (within 8), the log of one plus their sum, the square
    root of their mean, and the log of one plus the words."""
    if not len(p):
        return -8.0, 0.0, 0.0, 0.0
    top = float(p.max())
    odds = math.log(top + 1e-12) - math.log(1.0 - top + 1e-12)
    return max(-8.0, min(8.0, odds)), math.log1p(float(p.sum())), math.sqrt(float(p.mean())), math.log1p(len(p))


def fit_calibration(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; with one class only, its smoothed rate."""
    design = np.column_stack([np.ones(len(x)), x])
    coef = np.zeros(design.shape[1])
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        coef[0] = math.log(rate / (1.0 - rate))
        return coef
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ coef, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(coef))
        coef = coef + np.linalg.solve(hessian, design.T @ (y - p) - ridge * coef)
    return coef


class Scorer:
    """Marginals, spans and scores of texts; word scores are kept in a bounded cache."""

    def __init__(self, model: ToxicModel):
        self.model, self.cache = model, {}

    def score(self, texts: list[str | None]) -> list[tuple[float, tuple[float, ...], list[tuple[int, int]]]]:
        found = [WORDS.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for word in set().union(*found).difference(self.cache):
            self.cache[word] = self.model.unary(word.lower())
        lengths = np.array([len(words) for words in found], dtype=np.int64)
        get = self.cache.__getitem__
        unary = np.fromiter(map(get, chain.from_iterable(found)), dtype=np.float64, count=int(lengths.sum()))
        p = marginals(unary, lengths, self.model.trans)
        out, at = [], 0
        for text, n in zip(texts, lengths):
            own = p[at : at + n]
            at += n
            features = document_features(own)
            odds = float(self.model.calibration @ np.array([1.0, *features]))
            spans = []
            if n and own.max() >= TOXIC_FROM:
                places = [m.span() for m in WORDS.finditer(text)]
                hot = np.concatenate([[False], own >= TOXIC_FROM, [False]])
                turns = np.nonzero(hot[1:] != hot[:-1])[0]
                spans = [(places[i][0], places[j - 1][1]) for i, j in zip(turns[::2], turns[1::2])]
            out.append((1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, odds)))), features, spans))
        return out


RESULT = "struct<score:double, features:array<double>, spans:array<struct<start:int, end:int>>>"


def toxicity_of(text: Column, model: Broadcast) -> Column:
    """Struct column (score, features, spans) for a text column; ``model`` is a broadcast ``ToxicModel``."""

    @F.pandas_udf(RESULT)
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = model.value
        scorer = resident(held.key, lambda: Scorer(held))
        for batch in batches:
            texts, done = [t if isinstance(t, str) else None for t in batch], []
            for at in range(0, len(texts), 64):
                done += scorer.score(texts[at : at + 64])
            yield pd.DataFrame(
                {"score": [d[0] for d in done], "features": [list(d[1]) for d in done],
                 "spans": [[{"start": s, "end": e} for s, e in d[2]] for d in done]}
            )

    return compute(text)


def chosen_windows(marks: np.ndarray, order: int) -> list[int]:
    """Where up to ``WINDOWS_PER_DOC`` - 1 of a text's windows with marking words begin, pseudorandomly over all of it."""
    starts = dict.fromkeys(int(t) // WINDOW * WINDOW for t in np.nonzero(marks)[0])
    return sorted(sorted(starts, key=lambda s: zlib.crc32(b"%d %d" % (order, s)))[: WINDOWS_PER_DOC - 1])


def _windows(sample: DataFrame, evidence: dict) -> pd.DataFrame:
    """Training windows of the sample: around marking words anywhere in a text, and of harmless texts a pseudorandom one besides."""
    marks = sample.sparkSession.sparkContext.broadcast(frozenset(evidence))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, toxic, order in zip(batch["text"], batch["toxic"], batch["k1"]):
                words = WORDS.findall(text.lower())
                if not words:
                    continue
                found = token_marks(words, marks.value)
                tags = found if toxic else np.zeros(len(words), np.int8)
                starts = chosen_windows(found, int(order))
                if not toxic:  # such words stand in harmless texts too, and most words are harmless
                    starts.append(int(order) % (len(words) // WINDOW + 1) * WINDOW)
                for s in dict.fromkeys(starts):
                    if words[s : s + WINDOW]:
                        rows.append((" ".join(words[s : s + WINDOW]), "".join(map(str, tags[s : s + WINDOW]))))
            yield pd.DataFrame(rows, columns=["words", "tags"])

    return sample.select("text", "toxic", "k1").mapInPandas(cut, "words string, tags string").toPandas()


def train_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicModel:
    """Fits on about ``train_rows`` labelled rows (a pseudorandom sample; all, if fewer) outside the held-out fold.

    The driver gets the marking features, at most ``WINDOWS_PER_DOC`` windows a row and four numbers a row.
    """
    spark = docs.sparkSession
    marked = labels.where(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    n = texts.select("doc_id").join(marked, "doc_id").count()  # labels can cover more than the documents
    share = int(min(1.0, train_rows / max(n, 1)) * 1_000_000)
    chosen = marked.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1_000_000)) < share)
    k1, k2 = content_key("text")
    sample = written(
        texts.join(chosen, "doc_id")
        .select("text", "toxic", k1.alias("k1"), k2.alias("k2")),
        "labelled",
    )
    evidence = evidence_features(sample)
    weights, bias, trans = np.zeros(BUCKETS), 0.0, np.zeros((2, 2))
    if evidence:
        cut = _windows(sample, evidence)
        words = [w.split(" ") for w in cut["words"]]
        whole = [i for i, w in enumerate(words) if len(w) == WINDOW]
        short = [i for i, w in enumerate(words) if len(w) < WINDOW]
        filler = "\x00"  # pads short windows with a word of its own, always tagged as harmless
        words = [words[i] + [filler] * (WINDOW - len(words[i])) for i in whole + short]
        tags = np.array([[int(c) for c in cut["tags"][i].ljust(WINDOW, "0")] for i in whole + short])
        weights, bias, trans = fit_crf(words, tags)
    model = ToxicModel(weights, bias, trans, np.zeros(5))
    held = spark.sparkContext.broadcast(model)
    scored = sample.select("toxic", toxicity_of(F.col("text"), held).alias("r")).select("toxic", "r.features").toPandas()
    calibration = fit_calibration(np.array(scored["features"].tolist()).reshape(-1, 4), scored["toxic"].to_numpy(dtype=float))
    return ToxicModel(weights, bias, trans, calibration)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row of ``docs``.

    Learned from ``text`` and ``labels.toxic`` outside the held-out fold, scored from ``text`` alone. Null and empty
    texts have no marginals and get the calibration's base score. Several labels of one document count as toxic if one
    is; null labels and labels without a document are ignored; with no labels, or one class, every score is the
    smoothed rate. Repeated rows get equal scores, other columns are not read, an empty table gives an empty result.
    ``spans`` are the offending offsets (code points).
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train_toxicity(docs, labels, train_rows))
    scored = docs.select("doc_id", toxicity_of(F.col("text"), model).alias("r"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("r.score").alias("score"),
        (F.col("r.score") >= 0.5).cast("int").alias("predicted"), F.col("r.spans").alias("spans"),
    )
