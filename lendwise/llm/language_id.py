"""Language identification of mixed-language text.

Words are runs of letters. A word's script (by Unicode range) narrows its candidate languages to those that were
seen in that script; every candidate gets a score from hashed character n-grams; Viterbi over the words' scores, with
a penalty for each switch of language, labels spans. A document's language is the label of most letters.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import fresh, held_out, resident, small_batches

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
TRAIN_ROWS = 20_000
SWITCH = 12.0
WORST = 6.0
UNKNOWN = "und"
CACHE_WORDS = 300_000
WORDS = re.compile(r"[^\W\d_]+")

#: First code point of each script's ranges, in code-point order: fixed values.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"), (0x323B0, "other"),
)
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
SCRIPT_CODES = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words with their ends marked: (word index, bucket), and each word's script."""
    flat = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    first = points[np.cumsum(lengths) - lengths + 1]
    scripts = SCRIPT_CODES[np.searchsorted(SCRIPT_STARTS, first.astype(np.int64), side="right") - 1]
    at, bucket = [], []
    for order in ORDERS:
        if len(points) < order:
            continue
        value = np.full(len(points) - order + 1, order, dtype=np.uint64)
        for k in range(order):
            value = (value ^ points[k : len(points) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        inside = owner[: len(value)] == owner[order - 1 :]
        at.append(owner[: len(value)][inside])
        bucket.append((value[inside] >> np.uint64(7)).astype(np.int64) % BUCKETS)
    return np.concatenate(at), np.concatenate(bucket), scripts


@dataclass
class LanguageModel:
    """Log-probabilities ``logp[bucket, language]`` and ``seen[script, language]``; languages in code-point order."""

    languages: list[str]
    logp: np.ndarray
    seen: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score of each word in each language: mean n-gram log-probability per order, at most ``WORST`` below the best.

        Languages not seen in the word's script are no candidates; if none was, the word says nothing.
        """
        scores = np.zeros((len(words), len(self.languages)), dtype=np.float64)
        if not words or not self.languages:
            return scores
        owner, bucket, script = ngram_buckets([w.lower() for w in words])
        for k in range(len(self.languages)):
            scores[:, k] = np.bincount(owner, weights=self.logp[bucket, k], minlength=len(words))
        scores /= len(ORDERS)
        candidate = self.seen[script]
        scores = np.where(candidate, scores, -np.inf)
        best = scores.max(axis=1, keepdims=True)
        scores = np.maximum(scores - np.where(np.isfinite(best), best, 0.0), -WORST)
        scores[~candidate.any(axis=1)] = 0.0
        return scores


def train_language_model(docs: DataFrame, train_rows: int = TRAIN_ROWS, smoothing: float = 0.05) -> LanguageModel:
    """Counts n-grams over about ``train_rows`` labelled rows (a pseudorandom sample; all rows, if fewer).

    Rows with a null text or lang, and rows of the held-out fold, are never learned from. Counting runs on the
    executors; what reaches the driver is at most ``BUCKETS`` counts a language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = labelled.select("doc_id").count()
    share = min(1.0, train_rows / max(n, 1))
    sample = labelled.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words = [w.lower() for t in texts for w in WORDS.findall(t)]
                if not words:
                    continue
                _, bucket, script = ngram_buckets(words)
                sums = np.bincount(bucket, minlength=BUCKETS)
                scripts = np.bincount(script, minlength=len(SCRIPT_NAMES))
                at = np.nonzero(sums)[0]
                on = np.nonzero(scripts)[0]
                yield pd.DataFrame(
                    {"lang": lang, "bucket": np.concatenate([at, -1 - on]), "n": np.concatenate([sums[at], scripts[on]])}
                )

    counts = (
        sample.select("lang", "text").mapInPandas(count, "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(counts["lang"].unique())
    logp = np.zeros((BUCKETS, len(languages)))
    seen = np.zeros((len(SCRIPT_NAMES), len(languages)), dtype=bool)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        grams, scripts = own[own["bucket"] >= 0], own[own["bucket"] < 0]
        freq = np.full(BUCKETS, smoothing)
        freq[grams["bucket"].to_numpy()] += grams["n"].to_numpy()
        logp[:, k] = np.log(freq / freq.sum())
        share_of = scripts["n"].to_numpy() / scripts["n"].sum()
        seen[-1 - scripts["bucket"].to_numpy()[share_of >= 0.01], k] = True
    return LanguageModel(languages, logp, seen)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word when every change of label costs ``switch``; ties go to staying, then to the first."""
    rows = scores.tolist()  # a few languages: plain numbers beat arrays step by step
    value = rows[0]
    before, tops = [], []
    for row in rows[1:]:
        best = max(value)
        moved = best - switch
        before.append(value)
        tops.append((value.index(best), moved))
        value = [(v if v >= moved else moved) + s for v, s in zip(value, row)]
    path = [value.index(max(value))]
    for was, (top, moved) in zip(reversed(before), reversed(tops)):
        path.append(path[-1] if was[path[-1]] >= moved else top)
    return np.array(path[::-1])


def label_words(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """As ``viterbi``, but a text that no switch can improve is recognised at once.

    If, for every other language, no run of words gains more than half the penalty over the best single language, no
    path with switches is better: each of its runs pays for at least half a switch.
    """
    total = scores.sum(axis=0)
    best = int(total.argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
    low = np.vstack([np.zeros((1, gain.shape[1])), low[:-1]])
    if (gain - low).max() <= switch / 2:
        return np.full(len(scores), best)
    return viterbi(scores, switch)


class Tagger:
    """Labels texts with a model; word scores are kept in a bounded cache."""

    def __init__(self, model: LanguageModel):
        self.model, self.index, self.table = model, {}, np.zeros((1024, len(model.languages)))

    def _rows(self, found: list[list[str]]) -> None:
        words = set().union(*found)
        unseen = list(words.difference(self.index))
        if len(self.index) + len(unseen) > CACHE_WORDS:
            self.index, unseen = {}, list(words)
        if unseen:
            base, top = len(self.index), len(self.index) + len(unseen)
            if top > len(self.table):
                grown = np.zeros((2 * top, self.table.shape[1]))
                grown[:base] = self.table[:base]
                self.table = grown
            self.table[base:top] = self.model.word_scores(unseen)
            self.index.update(zip(unseen, range(base, top)))

    def tag(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """Per text: language, its share of the letters, and spans (language, start, end) in code points."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        found = [WORDS.findall(t) if t else [] for t in texts]
        self._rows(found)
        out = []
        for text, words in zip(texts, found):
            if not any(map(str.isalpha, words)):  # digits of other kinds are no letters
                out.append((UNKNOWN, 0.0, []))
                continue
            rows = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
            labels = label_words(self.table[rows])
            if (labels == labels[0]).all():
                out.append((self.model.languages[labels[0]], 1.0, [(self.model.languages[labels[0]], 0, len(text))]))
                continue
            letters = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            weight = np.bincount(labels, weights=letters, minlength=len(self.model.languages))
            top = int(weight.argmax())
            starts = np.array([m.start() for m in WORDS.finditer(text)])
            cut = [0, *(np.nonzero(np.diff(labels))[0] + 1).tolist()]
            ends = [int(starts[c]) for c in cut[1:]] + [len(text)]
            spans = [
                (self.model.languages[labels[c]], 0 if c == 0 else int(starts[c]), e) for c, e in zip(cut, ends)
            ]
            out.append((self.model.languages[top], float(weight[top] / weight.sum()), spans))
        return out


RESULT = "struct<lang:string, score:double, spans:array<struct<lang:string, start:int, end:int>>>"


def language_of(text: Column, model: Broadcast) -> Column:
    """Struct column (lang, score, spans) for a text column; ``model`` is a broadcast ``LanguageModel``.

    Marked as non-deterministic, so that a filter on the result is not pushed below it with a second evaluation.
    """

    @F.pandas_udf(RESULT)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = model.value
        tagger = resident(held.key, lambda: Tagger(held))
        for batch in batches:
            done = []
            texts = [t if isinstance(t, str) else None for t in batch]
            for at in range(0, len(texts), 64):
                done += tagger.tag(texts[at : at + 64])
            yield pd.DataFrame(
                {"lang": [d[0] for d in done], "score": [d[1] for d in done],
                 "spans": [[{"lang": a, "start": b, "end": c} for a, b, c in d[2]] for d in done]}
            )

    return tag.asNondeterministic()(text)


def identify_languages(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` for every row.

    Learned from ``text`` and ``lang`` alone, and predicted from ``text`` alone. ``und`` and score 0 for a text that is
    null or has no letter, and for all when there is nothing to learn from. Repeated rows get equal results, other
    columns are not read, an empty table gives an empty result. ``score`` is the label's share of the letters.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train_language_model(docs, train_rows))
    tagged = docs.select("doc_id", language_of(F.col("text"), model).alias("r"))
    return tagged.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("r.lang").alias("lang_pred"),
        F.col("r.score").alias("score"), F.col("r.spans").alias("spans"),
    )


def keep_identified(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the rows whose language cannot be told; ``lang`` becomes the language found."""
    spark = docs.sparkSession
    small_batches(spark)
    found = fresh(docs, "found")
    model = spark.sparkContext.broadcast(train_language_model(docs, train_rows))
    tagged = docs.withColumn(found, language_of(F.col("text"), model)).where(F.col(f"{found}.lang") != UNKNOWN)
    return tagged.withColumn("lang", F.col(f"{found}.lang")).drop(found)
