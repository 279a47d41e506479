"""PII by bootstrapped contextual extraction.

Four kinds of personal data have a fixed form (email, ip, card, phone) and are found by linear scans. They are the
seeds of the rest: every token with a digit is an instance, the words around it are patterns, and Spark scores the
graph of the two in rounds. A pattern is trusted as far as the instances it holds are; an instance as far as its
patterns are. Patterns that are trusted in the end, and were seen around enough different seeds, mark the other
instances they hold as identifiers (kind `id`). What the patterns of one round mark counts as a seed in the next, so
identifiers teach patterns that no base kind was seen in. Tokens without a digit, and those of fewer than `shortest`
code points, are never instances.

A pattern is made of whole words of the context, in lower case and with numbers as 0; a long one is kept as its
beginning and a hash of all of it. Of a word that holds several spans, what stands between them is a word of its own.

The text is read once. What is shuffled are instances and patterns, counted per document before the shuffle. Null and
empty texts have no spans. Rows are numbered when they are read, so rows that share a doc_id or have none keep their own
spans. Repeated rows count once for the graph, since edges are distinct. An empty table gives no rows. Other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, map_batches, ship, texts_of

# The kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin after a digit: one that begins at the digit before would be further left.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REST = re.compile(r"\S*+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address form, found from each @ outwards in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(map(_part_fits, m[0].split(".")))]


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 * (int(d) > 4)) for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 separators
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]


_HAS_DIGIT = re.compile("[0-9]")


def tokens_with_digits(text: str) -> Iterator[tuple[int, int]]:
    """White-space delimited tokens with a digit, each found from its first digit outwards."""
    end = 0
    while m := _HAS_DIGIT.search(text, end):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _REST.match(text, m.end()).end()
        yield start, end


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start and then kind in the order of KINDS."""
    found = [(s, "email", e) for s, e in emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        found += [(s, "ip", e) for s, e in ips(text)] + [(s, "card", e) for s, e in cards(text)]
        found += [(s, "phone", e) for s, e in phones(text)] if "+" in text else []
    return sorted(found, key=order)


def order(x: tuple[int, str, int]) -> tuple[int, int]:
    return x[0], KINDS.index(x[1])


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


#: Code points of a context word that are kept as they are; a longer one ends in a hash of the whole.
PLAIN = 32


def shape(word: str) -> str:
    """A context word without its case and its numbers."""
    word = re.sub("[0-9]+", "0", word.lower())
    if len(word) <= PLAIN:
        return word
    return word[: PLAIN // 2] + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


_WORD = re.compile(r"\S+")


class Context:
    """The words around spans of one text, in time linear in the text and the spans."""

    def __init__(self, text: str, spans: list[tuple[int, int, bool]]):
        self.text = text
        self.words = [m.span() for m in _WORD.finditer(text)]
        self.starts = [s for s, _ in self.words]
        self.shapes: dict[int, str] = {}
        self.begins, self.ends = sorted(s for s, _, _ in spans), sorted(e for _, e, _ in spans)

    def whole(self, i: int) -> str:
        if not 0 <= i < len(self.words):
            return ""
        if i not in self.shapes:
            self.shapes[i] = shape(self.text[slice(*self.words[i])])
        return self.shapes[i]

    def before(self, s: int) -> tuple[str, str]:
        """The last but one and the last word before s."""
        i = bisect.bisect_right(self.starts, s) - 1
        if i < 0:
            return "", ""
        own, end = self.words[i]
        if s >= end:  # s is not in a word
            return self.whole(i - 1), self.whole(i)
        k = bisect.bisect_right(self.ends, s)
        part = self.text[max(own, self.ends[k - 1] if k else 0) : s]
        return (self.whole(i - 1), shape(part)) if part else (self.whole(i - 2), self.whole(i - 1))

    def after(self, e: int) -> str:
        """The first word from e on."""
        i = bisect.bisect_right(self.starts, e) - 1
        if i >= 0 and e < self.words[i][1]:
            k = bisect.bisect_left(self.begins, e)
            part = self.text[e : min(self.words[i][1], self.begins[k] if k < len(self.begins) else len(self.text))]
            return shape(part) if part else ""
        return self.whole(i + 1)


def candidates(text: str, base: list[tuple[int, str, int]], shortest: int) -> list[dict]:
    """Tokens with a digit, or spans of a base kind, with the patterns around them."""
    taken = [(s, e, True) for s, _, e in base]
    out, k = list(taken), 0
    if _HAS_DIGIT.search(text):
        for s, e in tokens_with_digits(text):
            while e > s and not text[e - 1].isalnum():
                e -= 1
            while s < e and not text[s].isalnum():
                s += 1
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if e - s >= shortest and not (k < len(taken) and taken[k][0] < e):
                out.append((s, e, False))
    rows, context = [], Context(text, out) if out else None
    for s, e, seed in out:
        (l2, l1), r1 = context.before(s), context.after(e)
        patterns = [f"{l2} {l1} _"] * bool(l1) + [f"{l1} _ {r1}"] * bool(l1 and r1)
        if patterns:
            value = hashlib.blake2b(text[s:e].lower().encode("utf-8", "surrogatepass"), digest_size=8).digest()
            rows.append({"start": s, "end": e, "seed": seed, "value": int.from_bytes(value, "little", signed=True), "patterns": sorted(set(patterns))})
    return rows


SCAN = "array<struct<start:int,end:int,seed:boolean,value:bigint,patterns:array<string>>>"


def scan(docs: DataFrame, id_col: str, text_col: str, shortest: int) -> DataFrame:
    """doc_id, base spans and candidate tokens of every document, with a number of the row."""
    ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        base = [base_spans(x) for x in texts_of(batch, "text")]
        found = [candidates(x, b, shortest) for x, b in zip(texts_of(batch, "text"), base, strict=True)]
        return {"doc_id": batch.column(0), "base": [joined(b) for b in base], "candidates": found}

    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, base string, candidates {SCAN}").withColumn("row", F.monotonically_increasing_id())


def trusted_patterns(edges: DataFrame, scratch: Scratch, rounds: int, smoothing: float, least: float, least_seeds: int) -> DataFrame:
    """edges: distinct (pattern, value, seed). Scores patterns and instances in turn; returns trusted (pattern, trust).

    A pattern's trust is the mean trust of its instances, held down by `smoothing` instances of no trust. An instance
    is trusted as its best pattern is; seeds always are. A pattern's seeds are its instances of the base kinds and, from
    the second round on, those that a pattern good enough by the round before holds.
    """
    enough = (F.col("trust") >= least) & (F.col("seeds") >= least_seeds)
    edges = scratch.keep(edges)
    trust = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("trust"), F.max("seed").alias("sure"))
    patterns = None
    for i in range(rounds):
        # written first, so that both sides of the join are plain shuffles, which Spark can split where a value is common
        scored = edges.join(scratch.keep(trust), "value").groupBy("pattern").agg(F.sum("trust").alias("mass"), F.count(F.lit(1)).alias("n"), F.count_if("sure").alias("seeds"))
        patterns = scratch.keep(scored.select("pattern", "seeds", (F.col("mass") / (F.col("n") + smoothing)).alias("trust")).filter("trust > 0"))
        if i + 1 < rounds:
            found = edges.join(patterns, "pattern", "left")
            sure = F.col("seed") | F.coalesce(enough, F.lit(False))
            trust = found.groupBy("value").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(F.coalesce("trust", F.lit(0.0)))).alias("trust"), F.max(sure).alias("sure"))
    return patterns.filter(enough).select("pattern", "trust")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, smoothing: float = 2.0, least_trust: float = 0.5, least_seeds: int = 3, shortest: int = 6) -> DataFrame:
    """One row per document: base spans and identifiers found through context.

    shortest: the fewest code points of an identifier. least_seeds: how many different seeds a pattern must have held,
    of the base kinds or marked in an earlier round.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(scan(docs, id_col, text_col, shortest))
    tokens = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    edges = tokens.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    good = scratch.keep(trusted_patterns(edges, scratch, rounds, smoothing, least_trust, least_seeds))
    unseen = tokens.filter(~F.col("seed")).select("row", "start", "end", F.explode("patterns").alias("pattern"))
    hits = unseen.join(good, "pattern").groupBy("row", "start", "end").agg(F.max("trust").alias("trust"))
    # no identifier is collected with those of other documents; one document's are as many as its tokens at most
    by_row = scratch.keep(hits.groupBy("row").agg(F.collect_list(F.struct("start", "end", "trust")).alias("identifiers")))
    slim = scratch.keep(found.select("row", "doc_id", "base"))
    scratch.drop_all_but(slim, by_row)
    return slim.join(by_row, "row", "left").drop("row")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans in their order."""
    parts = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    count = lambda kind: F.size(F.filter(F.col("parts"), lambda x: x.startswith(f"{kind}:"))).cast("long")
    n = {f"n_{k}": count(k) for k in KINDS[:4]}
    kinds = F.array(*map(F.lit, KINDS))
    place = lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.array_position(kinds, F.split(x, ":")[0]).alias("kind"), x.alias("span"))
    more = F.transform(F.coalesce("identifiers", F.array().cast("array<struct<start:int,end:int,trust:double>>")), lambda x: F.concat(F.lit("id:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    spans = F.array_sort(F.transform(F.concat("parts", more), place))
    return found.withColumn("parts", parts).select("doc_id", *[v.alias(k) for k, v in n.items()], F.sha2("base", 256).alias("base_sha256"), F.array_join(F.transform(spans, lambda x: x["span"]), ",").alias("spans"), F.coalesce(F.size("identifiers"), F.lit(0)).cast("long").alias("n_id"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(documents(spark, sf_dir, "doc_id", "text")))
