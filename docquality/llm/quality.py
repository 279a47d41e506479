"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is the log-odds that it is good (and that it is toxic), from a logistic regression on how it
is written and on the labelled words it holds. Its site has evidence as well: documents of one host, and of one path of
that host, tend to be alike. Each level's share of good documents is drawn toward that of the level above, by as many
documents as the spread between groups of that level (of hosts around all, of paths around their host) calls for beyond
the spread within them (method of moments), so that sparse paths follow their host and sparse hosts follow all. A document does not count for its own site. The posterior adds the document's
log-odds and what its path's log-odds exceed the global ones by.

Labelled words are those of a bounded sample of labelled documents; a word's log-odds are shrunk by its few documents.
All documents count for the shares of their hosts and paths; groups are sums, whatever their size.

Defined results: null and empty texts have no words and get the evidence of that; null hosts and paths are groups of
their own; with no labels of both kinds, or fewer than LEAST_LABELS, the evidence is 0 and everything is kept. Rows with
one id are judged one by one, and each counts for its site. An empty table gives no rows. Other columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, holds_memory, map_batches, remembers, ship, table, texts_of

#: Labelled documents that are learned from, at most (in expectation).
SAMPLE_DOCS = 6000
#: Labels that a head is learned from at least; with fewer in the whole table it keeps everything.
LEAST_LABELS = 20
#: Steps in which shares of a class are taken.
FINE = 1 << 50
BUCKETS = 1 << 17
REMEMBERED = 300_000
HEADS = ("quality", "toxic")
STYLE = 10


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word) % BUCKETS
        return out


_buckets = _Buckets()
remembers("quality", _buckets.clear)
#: A-Z in lower case; what stands between words of letters becomes a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def buckets(raw: bytes) -> np.ndarray:
    """The distinct words of a text and the beginnings of its longer words, as numbers of buckets."""
    words = set(raw.translate(_LETTERS).split())
    words |= {b"^" + w[:6] for w in words if len(w) > 6}
    return np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))


def style(raw: bytes) -> list[float]:
    """How a text is written: shares of kinds of characters, lengths of words and lines, and repetition."""
    n = len(raw)
    if not n:
        return [0.0] * STYLE
    words, lines = raw.split(), raw.split(b"\n")
    upper = n - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = n - len(raw.translate(None, b"0123456789"))
    marks = n - len(raw.translate(None, b"#$%&*=<>{}[]^~\\+_@"))
    table = raw.count(b"|")
    loud = raw.count(b"!") + raw.count(b"?")
    plain = raw.count(b".") + raw.count(b",")
    w = max(1, len(words))
    return [upper / n, digits / n, marks / w, table / w, loud / w, plain / w, n / w / 10, math.log1p(w) / 10, len(set(words)) / w, len(set(lines)) / len(lines)]


class Model:
    """Word log-odds (buckets, heads) and the regression's weights over style and word evidence."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.words, self.weights, self.mean, self.scale = words, weights, mean, scale

    def features(self, raw: bytes, head: int) -> np.ndarray:
        return np.array([*style(raw), *word_evidence(self.words[buckets(raw), head])])

    def log_odds(self, text: str) -> list[float]:
        raw = text.encode("utf-8", "surrogatepass")
        own, known = style(raw), buckets(raw)
        out = []
        for k in range(len(HEADS)):
            x = (np.array([*own, *word_evidence(self.words[known, k])]) - self.mean[k]) / self.scale[k]
            out.append(float(np.clip(x @ self.weights[k, :-1] + self.weights[k, -1], -30, 30)))
        return out


def word_evidence(odds: np.ndarray) -> list[float]:
    """The strongest words for and against, and the mean of all."""
    if not len(odds):
        return [0.0] * 5
    top = np.sort(odds)
    return [top[-1], top[-3:].mean(), top[0], top[:3].mean(), odds.mean() * 10]


def word_log_odds(docs: list[np.ndarray], y: np.ndarray, w: np.ndarray, prior: float = 4.0) -> np.ndarray:
    """Of each bucket: the log-odds of its documents, with `prior` documents of the common share added. w: what each counts."""
    n, good, share = np.zeros(BUCKETS), np.zeros(BUCKETS), y @ w / w.sum()
    for d, label, weight in zip(docs, y, w, strict=True):
        n[d] += weight
        good[d] += weight * label
    p = (good + prior * share) / (n + prior)
    return np.log(p / (1 - p)) - math.log(share / (1 - share))


def regression(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method. counts: what each row counts, 1 on average."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (counts * (p - y)) / len(y) + ridge * w
        h = (x * (counts * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d * min(1.0, 5 / max(1e-9, np.abs(d).max()))
    return w


def learn(rows: list) -> Model:
    """rows: words (buckets), style, quality, toxic, weight of the sample. Word log-odds for the regression come from the
    other half of the sample, so that it learns what they are worth on documents that they were not counted on.

    Weights (how many labelled documents a row stands for) hold within a class; between the classes of a head the sample
    stays as it was drawn, and the intercept is corrected for that. A head with fewer than LEAST_LABELS rows, or with
    one class only, is not learned.
    """
    size = STYLE + 5
    words, weights, mean, scale = np.zeros((BUCKETS, 2)), np.zeros((2, size + 1)), np.zeros((2, size)), np.ones((2, size))
    for k, head in enumerate(HEADS):
        own = sorted(((r["id"], r) for r in rows if r[head] is not None), key=lambda x: x[0])
        y = np.array([float(r[head] > 0) for _, r in own])
        if len(y) < LEAST_LABELS or y.min() == y.max():
            continue
        w = np.array([r["weight"] for _, r in own])
        share = y @ w / w.sum()
        for label in (0.0, 1.0):
            w[y == label] /= w[y == label].mean()
        docs = [np.array(r["words"], np.int64) for _, r in own]
        half = np.arange(len(y)) % 2 == 0
        x = np.zeros((len(y), size))
        for side in (half, ~half):
            other = np.flatnonzero(~side)
            if y[other].min() == y[other].max():
                continue
            odds = word_log_odds([docs[i] for i in other], y[other], w[other])
            for i in np.flatnonzero(side):
                x[i] = [*own[i][1]["style"], *word_evidence(odds[docs[i]])]
        mean[k], scale[k] = x.mean(0), np.maximum(x.std(0), 1e-6)
        weights[k] = regression((x - mean[k]) / scale[k], y, w)
        weights[k, -1] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
        words[:, k] = word_log_odds(docs, y, w)
    return Model(words, weights, mean, scale)


def shares(sizes: dict[int, int], size: int) -> dict[int, float]:
    """What share of each class to take, so that `size` rows in all are dealt evenly; small classes are taken whole."""
    out = {}
    for i, (k, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, size / (len(sizes) - i))
        out[k] = take / n
        size -= take
    return out


def sample(docs: DataFrame, labels: DataFrame, size: int) -> list:
    """Words, style and weight of a sample of the labelled documents, drawn from each class (of both heads) for itself."""
    sign = lambda h: F.coalesce((F.col(h) > 0).cast("int"), F.lit(2))
    known = labels.groupBy("doc_id").agg(*[F.max(h).alias(h) for h in HEADS]).filter(F.coalesce(*HEADS).isNotNull()).withColumn("class", 3 * sign("quality") + sign("toxic"))
    share = F.lit(0.0)
    for k, x in shares({r["class"]: r["count"] for r in known.groupBy("class").count().collect()}, size).items():
        share = F.when(F.col("class") == k, x).otherwise(share)
    some = known.withColumn("share", share).filter(F.pmod(F.xxhash64("doc_id"), F.lit(FINE)) < F.col("share") * FINE)
    drawn = F.broadcast(some.select("doc_id", *HEADS, F.try_divide(F.lit(1.0), "share").alias("weight")))  # about `size` rows, whatever the table
    joined = docs.select("doc_id", "text").join(drawn, "doc_id")

    def look(batch: pa.RecordBatch) -> dict:
        raw = [x.encode("utf-8", "surrogatepass") for x in texts_of(batch, "text")]
        return {"id": batch.column(0), "words": [buckets(x) for x in raw], "style": [style(x) for x in raw], "quality": batch.column(2), "toxic": batch.column(3), "weight": batch.column(4)}

    return map_batches(joined.select("doc_id", "text", *[F.col(h).cast("int") for h in HEADS], "weight"), look, f"id {docs.schema['doc_id'].dataType.simpleString()}, words array<long>, style array<double>, quality int, toxic int, weight double").collect()


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-4)), F.lit(1e-4))
    return F.log(p / (1 - p))


def strength(groups: DataFrame) -> float:
    """Documents that a group's parent is worth: the variance within groups over that between groups of one parent.

    groups: n documents of the sum `mass`, of the sum of squares `sq` (without it, each is 0 or 1), under the parent of
    `pn` documents and the sum `pmass` (without them, under all).
    """
    has = set(groups.columns)
    if "pn" not in has:
        whole = groups.agg(F.sum("n"), F.sum("mass")).first()
        groups = groups.withColumns({"pn": F.lit(whole[0]), "pmass": F.lit(whole[1])})
    sq = F.col("sq") if "sq" in has else F.col("mass")
    apart = F.col("mass") / F.col("n") - F.col("pmass") / F.col("pn")
    r = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(sq - F.col("mass") * F.col("mass") / F.col("n")).alias("within"),
        F.sum(F.col("n") * apart * apart).alias("between"), F.sum(1 - F.col("n") / F.col("pn")).alias("free"), F.sum(F.col("n") * (1 - F.col("n") / F.col("pn"))).alias("size"),
    ).first()
    if not r["n"] or not r["size"] or r["size"] < 1e-9:
        return 1.0
    chance = max(r["within"], 0.0) / max(1.0, r["n"] - r["k"])
    spread = (r["between"] - r["free"] * chance) / r["size"]
    return float(min(max(chance / max(spread, 1e-12), 1.0), 1e6))


def with_site(scored: DataFrame, head: str, scratch: Scratch) -> DataFrame:
    """Adds <head>_site, what a document's path adds to its log-odds, without the document itself."""
    p = 1 / (1 + F.exp(-F.col(head)))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("mass"), F.sum(F.col("p") * F.col("p")).alias("sq")]
    x = scored.withColumn("p", p)
    paths = scratch.keep(x.groupBy("host", "path").agg(*sums))
    hosts = scratch.keep(paths.groupBy(F.col("host").alias("__host")).agg(F.sum("n").alias("hn"), F.sum("mass").alias("hmass"), F.sum("sq").alias("hsq")))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hmass").alias("mass")).first()
    share = (whole["mass"] / whole["n"]) if whole["n"] else 0.5
    # written first: where sites are few they are broadcast, else both sides are plain shuffles, which Spark can split
    sites = scratch.keep(paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).select("__host", F.col("path").alias("__path"), "n", "mass", "sq", "hn", "hmass"))
    k_host = strength(hosts.select(F.col("hn").alias("n"), F.col("hmass").alias("mass"), F.col("hsq").alias("sq")))
    k_path = strength(sites.select("n", "mass", "sq", F.col("hn").alias("pn"), F.col("hmass").alias("pmass")))
    y = x.join(sites, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")))
    host = (F.col("hmass") - F.col("p") + k_host * share) / (F.col("hn") - 1 + k_host)
    path = (F.col("mass") - F.col("p") + k_path * host) / (F.col("n") - 1 + k_path)
    return y.withColumn(f"{head}_site", logit(path) - logit(F.lit(float(share)))).select(*scored.columns, f"{head}_site")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, host, path, quality, toxic, score, toxicity, keep) of every document.

    host and path: columns or expressions of docs. quality and toxic are the document's own log-odds, score and
    toxicity the posterior probabilities; keep: more likely good than not, and more likely not toxic.
    """
    ship(docs.sparkSession)
    col = lambda c: docs[c] if isinstance(c, str) else c
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), col(host).cast("string").alias("host"), col(path).cast("string").alias("path"))
    rows = sample(src, labels.select(labels["doc_id"], *[labels[h] for h in HEADS]), sample_docs)
    model = learn(rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> dict:
        holds_memory("quality")
        odds = [sent.value.log_odds(x) for x in texts_of(batch, "text")]
        return {"doc_id": batch.column(0), "host": batch.column(2), "path": batch.column(3), "quality": [x[0] for x in odds], "toxic": [x[1] for x in odds]}

    scratch = Scratch(docs.sparkSession, "quality")
    scored = scratch.keep(map_batches(src, score, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, host string, path string, quality double, toxic double"))
    for head in HEADS:
        scored = with_site(scored, head, scratch)
    good, bad = (1 / (1 + F.exp(-(F.col(h) + F.col(f"{h}_site")))) for h in HEADS)
    learned = [bool(np.any(model.weights[k])) for k in range(2)]
    keep = ((F.col("score") >= 0.5) if learned[0] else F.lit(True)) & ((F.col("toxicity") < 0.5) if learned[1] else F.lit(True))
    return scored.withColumns({"score": good, "toxicity": bad}).withColumn("keep", keep).select("doc_id", "host", "path", "quality", "toxic", "score", "toxicity", "keep")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir, "doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"))
