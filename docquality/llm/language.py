"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a whole word byte by byte in both directions and gives each byte position a probability for every
language; a document's probabilities are pooled over all positions of all its words (the mean of their logarithms). It
is trained in numpy by backpropagation through time, on all words of a bounded sample of labelled documents; a word
counts as often as it occurs.

Words are runs of letters, in lower case and with a blank at each end; ASCII digits and marks part them. A word's
positions are labelled alike wherever it stands, so each worker remembers the pooled results of a bounded number of
words, and runs the network on new ones only, batched by length. A word of more than WINDOW bytes (unspaced scripts) is
read in windows that overlap, and each position counts in a window that shows at least CONTEXT bytes on each side of it.

Defined results: `und` with score 0 for null texts, texts without a letter, and where there was nothing to learn from.
Words without a letter count nowhere. Equal probabilities go to the first language by name. Rows are judged alone, so
repeated rows get equal results. An empty table gives no rows. Other columns pass through; a column that has the name of
a result is replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, holds_memory, map_batches, remembers, texts_of

#: Training documents, at most (in expectation). All their words are read.
SAMPLE_DOCS = 1200
#: Documents that a language is learned from at least, in expectation, if it has as many; a chance of 1e-13 to get none.
LEAST_OF_LANGUAGE = 30
#: Steps in which shares of a language are taken.
FINE = 1 << 50
#: Bytes of a word that are read at once, and bytes around a position that are seen at least where a word is longer.
WINDOW, CONTEXT = 256, 32
#: Words that a worker remembers, and bytes of the longest of them.
REMEMBERED, LONG = 300_000, 96
HIDDEN = 16
#: Batches that are trained on at least, however few words there are.
LEAST_STEPS = 500
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def step(x: np.ndarray, h: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """One position of a gated recurrent unit. x: its input (update, reset, new); returns the state and the gates."""
    n = h.shape[1]
    a = h @ u
    z, r = sigmoid(x[:, :n] + a[:, :n]), sigmoid(x[:, n : 2 * n] + a[:, n : 2 * n])
    m = a[:, 2 * n :] + c
    new = np.tanh(x[:, 2 * n :] + r * m)
    return new + z * (h - new), z, r, m, new


@dataclass
class Network:
    """Weights for each direction: e (256, 3H) of bytes, u (H, 3H) recurrent, c (H); and the output o (2H, L), b (L)."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: int, hidden: int, rng: np.random.Generator) -> Network:
        w = {}
        for d in ("f", "g"):
            w |= {f"{d}e": rng.normal(0, 0.3, (256, 3 * hidden)), f"{d}u": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"{d}c": np.zeros(hidden)}
        w |= {"o": rng.normal(0, 0.1, (2 * hidden, languages)), "b": np.zeros(languages)}
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def states(self, d: str, x: np.ndarray) -> list[tuple]:
        """What step() gives at each position of bytes x (words, length) in the order of reading."""
        e, u, c = (self.weights[d + k] for k in "euc")
        h = np.zeros((len(x), len(c)), np.float32)
        out = []
        for t in range(x.shape[1]):
            out.append(step(e[x[:, t]], h, u, c))
            h = out[-1][0]
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(words, length, languages): the label of every position."""
        hidden = len(self.weights["fc"])
        y = self.weights["b"] + (self.read("f", x) @ self.weights["o"][:hidden] + self.read("g", x[:, ::-1])[::-1] @ self.weights["o"][hidden:])
        y -= y.max(2, keepdims=True)
        y -= np.log(np.exp(y).sum(2, keepdims=True))
        return y.transpose(1, 0, 2)

    def read(self, d: str, x: np.ndarray) -> np.ndarray:
        """(length, words, hidden): the states alone, as states() has them."""
        e, u, c = (self.weights[d + k] for k in "euc")
        n = len(c)
        e, u = e.copy(), u.copy()
        e[:, : 2 * n] *= 0.5  # a sigmoid is half a tanh of the half
        u[:, : 2 * n] *= 0.5
        out = np.empty((x.shape[1], len(x), n), e.dtype)
        h = np.zeros((len(x), n), e.dtype)
        for t in range(x.shape[1]):
            row, a = e.take(x[:, t], 0), h @ u
            gates = np.tanh(row[:, : 2 * n] + a[:, : 2 * n])
            gates *= 0.5
            gates += 0.5
            m = a[:, 2 * n :]
            m += c
            m *= gates[:, n:]
            m += row[:, 2 * n :]
            new = np.tanh(m, out=m)
            h = h - new
            h *= gates[:, :n]
            h += new
            out[t] = h
        return out

    def gradients(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of all positions, by backpropagation through time."""
        w, (n, length) = self.weights, x.shape
        seen = {"f": self.states("f", x), "g": self.states("g", x[:, ::-1])}
        hidden = len(w["fc"])
        h = np.stack([np.concatenate([a[0], b[0]], 1) for a, b in zip(seen["f"], seen["g"][::-1], strict=True)], 1)
        y = h @ w["o"] + w["b"]
        p = np.exp(y - y.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[np.arange(n), :, label] -= 1
        dy = p * (weight[:, None, None] / (weight.sum() * length))
        out = {"o": h.reshape(-1, 2 * hidden).T @ dy.reshape(-1, dy.shape[2]), "b": dy.sum((0, 1))}
        dh_all = dy @ w["o"].T
        for d, own, order in (("f", slice(0, hidden), x), ("g", slice(hidden, None), x[:, ::-1])):
            dh_own = dh_all[:, :, own] if d == "f" else dh_all[:, ::-1, own]
            de, du, dc = np.zeros_like(w[d + "e"]), np.zeros_like(w[d + "u"]), np.zeros_like(w[d + "c"])
            back = np.zeros((n, hidden), np.float32)
            for t in range(length - 1, -1, -1):
                _, z, r, m, new = seen[d][t]
                before = seen[d][t - 1][0] if t else np.zeros((n, hidden), np.float32)
                dh = back + dh_own[:, t]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dn * m * r * (1 - r)
                dm = dn * r
                dx, da = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, dm], 1)
                hot = np.zeros((n, 256), np.float32)
                hot[np.arange(n), order[:, t]] = 1
                de += hot.T @ dx
                du += before.T @ da
                dc += dm.sum(0)
                back = dh * z + da @ w[d + "u"].T
            out |= {d + "e": de, d + "u": du, d + "c": dc}
        return out


def by_length(words: list[bytes]) -> dict[int, np.ndarray]:
    """The places of words of each length."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    return {int(k): np.flatnonzero(n == k) for k in np.unique(n)}


def as_bytes(words: list[bytes], at: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), -1)


def train(words: list[bytes], labels: np.ndarray, languages: int, hidden: int = HIDDEN, epochs: int = 3, batch: int = 512, rate: float = 0.01, seed: int = 7, counts: np.ndarray | None = None) -> Network:
    """Adam over batches of words of one length. Languages weigh alike, however many words they have; within one a word
    weighs as often as it occurs (counts)."""
    rng = np.random.default_rng(seed)
    net = Network.new(languages, hidden, rng)
    n = np.ones(len(words)) if counts is None else counts
    weight = (n / np.maximum(1, np.bincount(labels, n, minlength=languages))[labels]).astype(np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in net.weights.items()} for _ in range(2))
    groups, k = by_length(words), 0
    epochs = max(epochs, -(-LEAST_STEPS // max(1, sum(-(-len(at) // batch) for at in groups.values()))))
    total = epochs * sum(-(-len(at) // batch) for at in groups.values())
    for _ in range(epochs):
        parts = [part for at in groups.values() for part in np.array_split(rng.permutation(at), -(-len(at) // batch))]
        for i in rng.permutation(len(parts)):
            k += 1
            grads = net.gradients(as_bytes(words, parts[i]), labels[parts[i]], weight[parts[i]])
            now = rate * (1 - 0.9 * k / total)
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                net.weights[name] -= (now * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


#: ASCII other than a-z becomes a blank; all else stays.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def has_letter(word: bytes) -> bool:
    return any(97 <= c <= 122 for c in word) or any(map(str.isalpha, word.decode("utf-8", "replace")))


def windows(word: bytes) -> list[tuple[bytes, int, int]]:
    """A word between blanks: (bytes to read, first and last position that count there)."""
    raw = b" " + word + b" "
    if len(raw) <= WINDOW:
        return [(raw, 0, len(raw))]
    step, out = WINDOW - 2 * CONTEXT, []
    for at in range(0, len(raw), step):
        start = max(0, min(at - CONTEXT, len(raw) - WINDOW))
        out.append((raw[start : start + WINDOW], at - start, min(at + step, len(raw)) - start))
    return out


class Sums:
    """Vectors by name, in one growing array."""

    def __init__(self, width: int):
        self.places: dict = {}
        self.rows = np.zeros((4096, width), np.float32)

    def add(self, names: list, rows: np.ndarray) -> None:
        start = len(self.places)
        while len(self.rows) < start + len(names):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[start : start + len(names)] = rows
        self.places.update(zip(names, range(start, start + len(names)), strict=True))

    def at(self, names: list) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, names), np.int64, len(names))


class Reader:
    """Pools labels of positions: of words by the network, of texts by sums over their words. It remembers words."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.net, self.width = Network(weights), len(weights["b"]) + 1
        self.words = Sums(self.width)

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """For each word: sums of log-probabilities over its positions, and the number of positions."""
        out = np.zeros((len(words), self.width))
        cut = [(i, *w) for i, word in enumerate(words) if has_letter(word) for w in windows(word)]
        raw = [c[1] for c in cut]
        owner, lo, hi = (np.array([c[k] for c in cut], np.int64) for k in (0, 2, 3))
        for n, at in by_length(raw).items():
            for part in np.array_split(at, -(-len(at) * n // 65_536)):
                got = self.net.log_probabilities(as_bytes(raw, part))
                if n < WINDOW:
                    total = got.sum(1)
                else:
                    total = np.array([g[a:b].sum(0) for g, a, b in zip(got, lo[part], hi[part], strict=True)])
                np.add.at(out, owner[part], np.concatenate([total, (hi[part] - lo[part])[:, None]], 1))
        return out

    def read(self, texts: list[str]) -> np.ndarray:
        """(texts, languages + 1): sums over all positions, and their number."""
        words = [words_of(t) for t in texts]
        long = [(i, x) for i, w in enumerate(words) if w and len(max(w, key=len)) > LONG for x in w if len(x) > LONG]  # not remembered
        for i in {i for i, _ in long}:
            words[i] = [x for x in words[i] if len(x) <= LONG]
        if len(self.words.places) > REMEMBERED:
            self.words = Sums(self.width)
        if new := list(set().union(*words).difference(self.words.places)):
            self.words.add(new, self.pooled(new))
        out = np.zeros((len(texts), self.width))
        for i, w in enumerate(words):
            if w:
                out[i] = self.words.rows[self.words.at(w)].sum(0, dtype=np.float64)
        if long:
            np.add.at(out, [i for i, _ in long], self.pooled([x for _, x in long]))
        return out


_readers: dict[str, Reader] = {}
remembers("language", _readers.clear)


def reader_of(mark: str, weights: dict[str, np.ndarray]) -> Reader:
    """The one reader of this worker process, for the model so marked; it lasts for all tasks of the worker."""
    holds_memory("language")
    if mark not in _readers:
        _readers.clear()
        _readers[mark] = Reader(weights)
    return _readers[mark]


def sample(docs: DataFrame, eligible: Column, sample_docs: int, sample_words: int | None = None) -> DataFrame:
    """(lang, words) of a sample of the labelled documents that are eligible; sample_words: evenly spread words of each,
    or (None) all.

    Every language gets an equal part of sample_docs, in expectation, and LEAST_OF_LANGUAGE documents if that is less;
    one that has fewer is taken whole. So the languages that are learned do not depend on the size of the table.
    """
    src = docs.filter(eligible & F.col("lang").isNotNull() & F.col("text").rlike(r"[^\x00-\x20]"))
    sizes = src.groupBy("lang").count().collect()
    each = max(LEAST_OF_LANGUAGE, sample_docs / max(1, len(sizes)))
    parts = docs.sparkSession.createDataFrame([(r["lang"], round(min(1.0, each / r["count"]) * FINE)) for r in sizes], "l string, part long")
    part = src.join(F.broadcast(parts), F.col("lang") == F.col("l")).filter(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(FINE)) < F.col("part"))

    def some(batch: pa.RecordBatch) -> dict:
        words = [words_of(x) for x in texts_of(batch, "text")]
        if sample_words is not None:
            words = [[w[i] for i in np.unique(np.linspace(0, len(w) - 1, min(len(w), sample_words)).astype(int))] if w else [] for w in words]
        return {"lang": batch.column(0), "words": words}

    return map_batches(part.select("lang", "text"), some, "lang string, words array<binary>")


def sampled_words(docs: DataFrame, eligible: Column, sample_docs: int, sample_words: int | None = None) -> list:
    return sample(docs, eligible, sample_docs, sample_words).collect()


def learned(counted: list[tuple[str, bytes, int]]) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """The languages, and the weights of a network trained on (lang, word, times); none where there are no words."""
    # by language and word, so that the order in which tasks end does not matter
    known = sorted(x for x in counted if has_letter(x[1]))
    if not known:
        return None
    languages = sorted({x[0] for x in known})
    number = {x: k for k, x in enumerate(languages)}
    labels, words, counts = [], [], []
    for lang, word, n in known:
        for x, _, _ in windows(word):
            labels.append(number[lang])
            words.append(x)
            counts.append(n)
    return languages, train(words, np.array(labels), len(languages), counts=np.array(counts, float)).weights


def model(docs: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """What is learned from the rows that eligible (a condition on doc_id, text, lang) holds for."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    words = sample(src, eligible, sample_docs).select("lang", F.explode("words").alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).toArrow()  # of a bounded sample
    return learned(list(zip(*(counted.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)))


def label(docs: DataFrame, known: tuple[list[str], dict[str, np.ndarray]] | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the language of every text and its probability."""
    base = docs.drop(pred_col, score_col)
    if known is None:
        return base.withColumns({pred_col: F.lit(UNKNOWN), score_col: F.lit(0.0)})
    languages, weights = known
    names, mark = base.columns, uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        got = reader_of(mark, weights).read(texts_of(batch, text_col))
        n = got[:, -1:]
        mean = got[:, :-1] / np.maximum(n, 1)
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        some = n[:, 0] > 0
        return dict(zip(names, batch.columns, strict=True)) | {pred_col: [languages[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)], score_col: np.where(some, p.max(1), 0.0)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{pred_col}` string, `{score_col}` double"
    return map_batches(base, run, schema)


def identify(docs: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs with lang_pred and score. eligible: which rows (of doc_id, text, lang) may be learned from."""
    return label(docs, model(docs, eligible, id_col, text_col, lang_col, sample_docs), text_col)


def fold(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(-1))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    out = identify(docs, fold() > 0)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
