"""License scans: ordered signature rules behind a keyword gate.

A rule (license_rules.py) is a regular expression over the normalised words of a text, with a label, a priority and a
keyword that each of its matches holds. One Aho-Corasick pass finds which keywords a text holds; only their rules run.
Detections are then settled in order of priority, length, place and rule: one that lies within a stronger detection, or
around one, is suppressed.

Defined results: null and empty texts have no words and no labels. Ties are settled by rule order, so the result is the
same on every run. Rows are scanned one by one, so repeated rows, and rows that share a doc_id or have none, get their
own results. An empty table gives no rows. Other columns are not looked at, whatever their names. Work per document is
linear in its text, and nothing is shuffled.
"""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, texts_of
from .license_rules import RULES

# The phrases of the base result and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

@dataclass(frozen=True)
class Rule:
    label: str
    regex: re.Pattern
    priority: int
    keyword: str


@functools.cache
def rules() -> tuple[Rule, ...]:
    """The rules in their order, between word boundaries."""
    return tuple(Rule(label, re.compile(rf"(?<![^ ]){x}(?![^ ])"), strength, keyword) for label, keyword, strength, x in RULES)


@functools.cache
def gate() -> ahocorasick.Automaton:
    """Finds the keywords; a value holds the numbers of the rules behind one."""
    behind: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        behind.setdefault(rule.keyword, []).append(i)
    out = ahocorasick.Automaton()
    for keyword, numbers in behind.items():
        out.add_word(keyword, tuple(numbers))
    out.make_automaton()
    return out


#: Bytes of a word (0-9, a-z, all of UTF-8 beyond ASCII) stay, A-Z go to lower case, all else becomes a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split()


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every base phrase, by start."""
    out, at = [], -1
    phrases = [(p.encode().split(), label) for p, label in BASE_PHRASES.items()]
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return sorted(out)
        for p, label in phrases:
            if (start := at + 1 - len(p)) >= 0 and words[start : at + 1] == p:
                out.append((start, label))


def detections(normal: str) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label) of what remains in normalised text after suppression, by start."""
    wanted = sorted({i for _, numbers in gate().iter(normal) for i in numbers})
    found = []
    for i in wanted:
        rule = rules()[i]
        found += [(m.start(), m.end(), rule.priority, rule.label) for m in rule.regex.finditer(normal)]
    # the strongest first; what stays never nests, so starts and ends are in the same order and bisection finds nesting
    found.sort(key=lambda x: (-x[2], x[0] - x[1], x[0]))
    kept: list[tuple[int, int, int, str]] = []
    for x in found:
        at = bisect.bisect_left(kept, (x[0],))
        within = at < len(kept) and kept[at][0] == x[0] and kept[at][1] >= x[1] or at > 0 and kept[at - 1][1] >= x[1]
        around = at < len(kept) and kept[at][1] <= x[1]
        if not within and not around:
            kept.insert(at, x)
    return kept


def scan_text(text: str) -> dict:
    words = words_of(text)
    row = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "detections": []}
    if not words:
        return row
    normal = b" ".join(words).decode("utf-8", "surrogatepass")
    base = base_places(words) if b"license" in words else []
    kept = detections(normal)
    labels = {label for _, label in base} | {x[3] for x in kept}
    row["detections"] = [{"label": x[3], "start": x[0], "end": x[1], "priority": x[2]} for x in kept]
    if base:
        row |= {"n_base": len(base), "first_word": base[0][0], "last_word": base[-1][0], "base_labels": ",".join(sorted({x[1] for x in base}))}
    row["labels"] = ",".join(sorted(labels))
    row["score"] = max([min(1.0, x[2] / 100) for x in kept] + [0.5] * bool(base) + [0.0])
    return row


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, base phrases, labels, score, and the detections with their places in the
    normalised text (words joined by single spaces)."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def scan(batch: pa.RecordBatch) -> dict:
        rows = [scan_text(x) for x in texts_of(batch, "text")]
        return {"doc_id": batch.column(0), **{k: [r[k] for r in rows] for k in rows[0]}}

    kind = src.schema["doc_id"].dataType.simpleString()
    return map_batches(src, scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:int,end:int,priority:int>>")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir, "doc_id", "text")).drop("detections")
