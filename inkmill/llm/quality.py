"""Quality classifier: document evidence shrunk by hierarchical empirical Bayes over hosts and paths.

Two judgements are made of each document, good or poor and toxic or not, in three steps:

* A document classifier gives each document a log-odds. It is fitted on at most ``SAMPLE`` labelled documents: logistic
  regression on shape features for quality; for toxicity on counts of the words that the sample shows to go with it.
* Hosts and paths (host and section) get posteriors by grouped aggregation over all documents. A document counts with
  its label where it has one, else with its classifier's probability. A host's rate is shrunk towards the global rate
  and a path's towards its host's, each by a prior strength that the spread of the rates tells (method of moments), so
  sites with few documents say little.
* The log-odds of a document is its evidence plus the log-odds by which its path's posterior differs from the global
  rate, times ``SITE_WEIGHT``.

A document is kept if it is good with a probability of at least ``KEEP_QUALITY`` and toxic with less than ``DROP_TOXIC``.
If the sample holds one class only, all evidence for that judgement is the sample's rate, shrunk towards a half.

Null texts are empty and are scored like others; null hosts and sections are groups of their own; labels that are null or
without a document are not used; of several labels of one document the largest counts. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import LOWER, UPPER, lookup, written
from inkmill.llm.repeats import by_bytes

SAMPLE = 8_000  # labelled documents the classifier is fitted on, at most
KEEP_QUALITY, DROP_TOXIC = 0.5, 0.5
SITE_WEIGHT = 0.5
MIN_WORD_DOCS = 4  # documents of the sample that have to hold a word before it counts
TOP_WORDS = 2_000  # words the toxicity model has at most

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(UPPER.encode() + _PUNCTUATION, LOWER.encode() + b" " * len(_PUNCTUATION))
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = True
_SHOUTS = np.zeros(256, dtype=bool)
_SHOUTS[[ord(c) for c in "!?"]] = True
_CAPITALS = np.zeros(256, dtype=bool)
_CAPITALS[65:91] = True
_DIGITS = np.zeros(256, dtype=bool)
_DIGITS[48:58] = True
FEATURES = 9


def plain_words(text: bytes) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    return text.translate(_PLAIN).split()


def shape(text: bytes) -> list[float]:
    """Shares of kinds of characters and of repetition, none of which grows with the text."""
    values = np.frombuffer(text, dtype=np.uint8)
    n = max(len(values), 1)
    words = text.split()
    count = max(len(words), 1)
    distinct = len(set(words)) / count
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / count
    kinds = np.bincount(values, minlength=256)
    return [
        float(np.sqrt(kinds[_SYMBOLS].sum() / n)),
        float(np.sqrt(kinds[_SHOUTS].sum() / n)),
        float(kinds[_CAPITALS].sum() / n),
        float(kinds[_DIGITS].sum() / n),
        again,
        distinct,
        float(np.log1p(len(words))) * distinct,
        min(n / count, 30.0),
        float(np.log1p(len(words))),
    ]


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the last one the constant, by Newton's method with a ridge."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """What is fitted on the sample; small, whatever the corpus."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    good: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    words: dict[bytes, float] = field(default_factory=dict)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def hits(self, text: bytes) -> list[float]:
        """Weight of toxic words: the strongest, the sum, and how many there are for the length."""
        if not self.words:
            return [0.0, 0.0, 0.0]
        words = plain_words(text)
        found = [self.words[w] for w in words if w in self.words]
        return [max(found, default=0.0), float(np.log1p(sum(found))), 10 * len(found) / (len(words) + 20)]

    def score(self, text: bytes) -> tuple[float, float]:
        """Log-odds of good and of toxic."""
        good = (np.array(shape(text)) - self.mean) / self.scale @ self.good[:-1] + self.good[-1]
        toxic = np.array(self.hits(text)) @ self.toxic[:-1] + self.toxic[-1]
        return float(np.clip(good, -12, 12)), float(np.clip(toxic, -12, 12))


def _constant(labels: np.ndarray) -> float:
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    return float(np.log(rate / (1 - rate)))


def fit(texts: list[bytes], quality: np.ndarray, toxic: np.ndarray) -> Model:
    """The model of a sample; negative labels are unknown."""
    model = Model()
    known = quality >= 0
    if known.any():
        shapes = np.array([shape(t) for t, k in zip(texts, known, strict=True) if k])
        model.mean, model.scale = shapes.mean(axis=0), shapes.std(axis=0) + 1e-6
        if len(set(quality[known])) == 2:
            model.good = logistic((shapes - model.mean) / model.scale, quality[known])
        else:
            model.good[-1] = _constant(quality[known])
    known = np.flatnonzero(toxic >= 0)
    model.toxic[-1] = _constant(toxic[known])
    if len(set(toxic[known])) == 2:
        # Distinct texts, so that copies of one do not make its words look telling.
        known = [i for i in {texts[i]: i for i in known.tolist()}.values()]
        labels = toxic[known]
        # Only words of several toxic texts can tell; the others are not held.
        held = Counter(w for i, y in zip(known, labels, strict=True) if y for w in set(plain_words(texts[i])))
        seen = {word: [0, n] for word, n in held.items() if n >= MIN_WORD_DOCS}
        for i, label in zip(known, labels.tolist(), strict=True):
            if not label:
                for word in seen.keys() & set(plain_words(texts[i])):
                    seen[word][0] += 1
        yes, no = labels.sum(), len(labels) - labels.sum()
        weights = {}
        for word, (a, b) in seen.items():
            odds = np.log((b + 0.05) / (yes + 0.1)) - np.log((a + 0.05) / (no + 0.1))
            deviation = np.sqrt(1 / (b + 0.05) + 1 / (a + 0.5))
            if odds > 1.5 and odds > 2.5 * deviation:
                weights[word] = odds - deviation
        top = sorted(weights, key=lambda w: (-weights[w], w))[:TOP_WORDS]
        model.words = {w: float(weights[w]) for w in top}
        hits = np.array([model.hits(texts[i]) for i in known])
        model.toxic = logistic(hits, labels, ridge=0.1)
    return model


# ---- the corpus -----------------------------------------------------------------------------------


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list:
    """At most about ``most`` labelled documents, drawn by a hash of their id."""
    count = labels.count()
    share = min(1.0, most / max(count, 1))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    chosen = labels.filter(drawn)  # its size has the bound
    return docs.join(F.broadcast(chosen), "_id").select("_id", "_text", "_quality", "_toxic").collect()


def _rate(label: Column, odds: Column) -> Column:
    return F.coalesce(label.cast("double"), 1 / (1 + F.exp(-odds)))


def _strength(groups: DataFrame, rate: str, n: str, mean: float) -> float:
    """Prior strength by moments: how far rates of groups differ beyond what their sizes explain."""
    r = groups.agg(
        F.sum(F.col(n) * (F.col(rate) - mean) ** 2).alias("between"), F.sum(n).alias("n"), F.count("*").alias("groups"),
        F.sum(F.col(n) ** 2).alias("squares"),
    ).first()
    inside = mean * (1 - mean)
    if not r.n or r.groups < 2 or inside <= 0:
        return 1000.0
    spread = (r.between - (r.groups - 1) * inside) / max(r.n - r.squares / r.n, 1e-9)
    return float(min(max(inside / spread - 1, 1.0), 1000.0)) if spread > 0 else 1000.0


def _odds(p: Column) -> Column:
    bounded = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(bounded / (1 - bounded))


def classified(
    docs: DataFrame,
    labels: DataFrame,
    host: str = "source",
    section: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    most: int = SAMPLE,
) -> DataFrame:
    """Id, evidence, site effects, ``p_quality``, ``p_toxic`` and ``kept`` of every document."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_text"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\0")).alias("_host"),
        F.coalesce(F.col(f"`{section}`").cast("string"), F.lit("\0")).alias("_section"),
    )
    known = written(
        labels.filter(F.col(f"`{label_id}`").isNotNull())
        .groupBy(F.col(f"`{label_id}`").alias("_id"))
        .agg(F.max(F.col("quality").cast("int")).alias("_quality"), F.max(F.col("toxic").cast("int")).alias("_toxic")),
        "quality-labels",
    )
    rows = sampled(texts, known, most)
    rows.sort(key=lambda r: r._id)
    unknown = lambda v: -1 if v is None else int(v > 0)
    model = fit(
        [bytes(r._text) for r in rows],
        np.array([unknown(r._quality) for r in rows], dtype=np.int64),
        np.array([unknown(r._toxic) for r in rows], dtype=np.int64),
    )
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (part for whole in batches for part in by_bytes(whole, 1, 1 << 22)):
            scores = [own.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), batch.column(3),
                    pa.array([s[0] for s in scores], pa.float64()), pa.array([s[1] for s in scores], pa.float64()),
                ],
                names=["_id", "_host", "_section", "good", "bad"],
            )

    kind = texts.schema["_id"].dataType.simpleString()
    scored = written(
        texts.mapInArrow(score, f"_id {kind}, _host string, _section string, good double, bad double"), "quality-scores"
    )
    counted = lookup(scored, known, ["_id"]).select(
        "_host", "_section",
        _rate(F.col("_quality"), F.col("good")).alias("q"), _rate(F.col("_toxic"), F.col("bad")).alias("t"),
    )
    paths = written(
        counted.groupBy("_host", "_section").agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t")),
        "quality-paths",
    )
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("q").alias("hq"), F.sum("t").alias("ht"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t")).first()
    n = whole.n or 0
    for name in ("q", "t"):
        mean = ((whole[name] or 0.0) + 0.5) / (n + 1)
        up = _strength(hosts.withColumn("r", F.col(f"h{name}") / F.col("hn")), "r", "hn", mean)
        hosts = hosts.withColumn(f"host_{name}", (F.col(f"h{name}") + up * mean) / (F.col("hn") + up))
        low = _strength(paths.withColumn("r", F.col(name) / F.col("n")), "r", "n", mean)
        hosts = hosts.withColumns({f"mean_{name}": F.lit(mean), f"low_{name}": F.lit(low)})
    sites = paths.join(hosts, "_host")
    for name in ("q", "t"):
        strength = F.col(f"low_{name}")
        rate = (F.col(name) + strength * F.col(f"host_{name}")) / (F.col("n") + strength)
        sites = sites.withColumn(f"site_{name}", SITE_WEIGHT * (_odds(rate) - _odds(F.col(f"mean_{name}"))))
    sites = written(sites.select("_host", "_section", "site_q", "site_t"), "quality-sites")
    good, bad = F.col("good") + F.col("site_q"), F.col("bad") + F.col("site_t")
    judged = lookup(scored, sites, ["_host", "_section"]).select(
        F.col("_id").alias(id_col),
        F.col("good").alias("quality_evidence"), F.col("site_q").alias("site_quality"),
        F.col("bad").alias("toxic_evidence"), F.col("site_t").alias("site_toxic"),
        (1 / (1 + F.exp(-good))).alias("p_quality"), (1 / (1 + F.exp(-bad))).alias("p_toxic"),
    )
    return judged.withColumn("kept", (F.col("p_quality") >= KEEP_QUALITY) & (F.col("p_toxic") < DROP_TOXIC))
