"""Toxicity: lexicon hits, misspelled ones too, weighed by their context.

The lexicon is learned from labelled documents: words, and stems that many
words begin with, that toxic documents hold and others don't.  Equal texts are
learned from once, and an entry needs a number of toxic texts, not a share of
them: neither copies nor more labels push out the terms of a rare language.  A
word hits an entry within the edits that its length allows (``automaton``); words of documents
labelled as not toxic, and beginnings of them near a stem, are never taken for misspellings.  A hit counts less when
its context window quotes it, more when it addresses someone, and a logistic
model of the document's summed hits gives the score.

Defined cases: null or empty text has no hits and the score of such documents;
repeated rows are scored each; null doc_id is kept (not held out); without
labels the lexicon is empty; an empty table gives no rows; other columns are
ignored (kept by ``without_toxic``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cohortlens.llm.automaton import Entry, LexiconAutomaton
from cohortlens.llm.labels import held_out, training_rows
from cohortlens.llm.registry import register
from cohortlens.llm.tables import read, stage
from cohortlens.llm.words import chunks, tidy_worker

#: Most labelled documents that the lexicon and the model learn from.
TRAINING_ROWS = 20_000
STEMS = range(4, 9)
#: Least toxic documents with an entry, least share of toxic ones among its
#: documents, and least log-likelihood ratio against the share among all.
SUPPORT, PRECISION, EVIDENCE = 4, 0.9, 16.0
#: Entries of at least this length, words and stems, allow one edit.
EDIT_LENGTH = 5
FUZZY, QUOTED, DIRECTED, WINDOW = 0.85, 0.3, 1.2, 5
THRESHOLD = 0.5
#: Word forms that one task remembers; beyond it the memory starts anew.
KEPT_WORDS = 200_000
#: Rows of a batch that are Python objects at once.
ROWS = 1024

# Quotation marks, words that report speech, words of address.
QUOTES = "\"“”„«»"
REPORTING = frozenset("said says called quote quoted word term sagte nannte zitat wort dit appelle citation mot dijo llama cita palabra".split())
ADDRESS = frozenset("you your youre du dich dein tu toi vous te usted".split())

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def _bare(word: str) -> str:
    return _EDGE.sub("", word)


class Model(NamedTuple):
    entries: list[Entry]
    spared: frozenset[str]  # misspellings (``_misspelled``) that clean documents use
    weights: np.ndarray


def _misspelled(word: str, entry: Entry) -> str:
    """What tells a word from the entry that it hits with an edit: the word and
    ``$``, or for a stem the beginning that any words near it share."""
    return word + "$" if entry.whole else word[:len(entry.text) - 1]


def _terms(texts: list[str]) -> Iterator[set[str]]:
    """Words (ending in ``$``) and stems of each text, each once."""
    for t in texts:
        words = {b for w in set(t.lower().split()) if (b := _bare(w))}
        yield {w + "$" for w in words} | {w[:k] for w in words for k in STEMS if len(w) >= k}


def lexicon(rows: DataFrame) -> list[Entry]:
    """Entries from (doc_id, text, label)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a in range(0, len(texts), 200):
                counts: dict[str, list[int]] = {}
                for terms, y in zip(_terms(texts[a:a + 200]), labels[a:a + 200]):
                    for t in terms:
                        counts.setdefault(t, [0, 0])[y] += 1
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["term", "clean", "toxic"])

    counts = rows.mapInArrow(emit, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    y, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    prior = min(max(y / max(n, 1), 1e-6), 1 - 1e-6)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    ratio = F.col("toxic") * F.log(share / prior) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - prior))).otherwise(0.0)
    good = counts.filter((F.col("toxic") >= SUPPORT) & (share >= PRECISION)).filter(ratio >= EVIDENCE)
    found = {r["term"]: (r["toxic"], r["clean"]) for r in good.collect()}  # of at most TRAINING_ROWS texts, in SUPPORT of them or more
    # along a word's stems, the longest one that keeps most documents of the shortest
    chosen: dict[str, int] = {}
    for term, (toxic, _) in sorted(found.items(), key=lambda x: (len(x[0].rstrip("$")), x[0])):
        bare = term.rstrip("$")
        before = [bare[:k] for k in STEMS if k < len(bare) and bare[:k] in chosen]
        if term.endswith("$") and bare in chosen:
            before.append(bare)
        if any(toxic < 0.8 * chosen[b] for b in before):
            continue
        for b in before:
            del chosen[b]
        chosen[term] = toxic
    best = sorted(chosen, key=lambda t: (-chosen[t], t))
    weight = lambda t: math.log((found[t][0] + 0.5) / (found[t][1] + 0.5))
    return [Entry(t.rstrip("$"), t.endswith("$"), int(len(t.rstrip("$")) >= EDIT_LENGTH), weight(t)) for t in best]


class Matcher:
    """Hits of texts; remembers the word forms it has seen."""

    def __init__(self, entries: list[Entry], spared: frozenset[str]) -> None:
        self.entries, self.spared = entries, spared
        self.automaton = LexiconAutomaton(entries)
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def words(self, texts: list[bytes]) -> list[list[str]]:
        lists = [t.decode().lower().split() for t in texts]
        if len(self.seen) > KEPT_WORDS:
            self.seen, self.hits = set(), {}
        new = list(set().union(*lists) - self.seen)
        bare = [_bare(w) if not w.isalnum() else w for w in new]
        for form, word, hit in zip(new, bare, self.automaton.match(bare)):
            if hit and not (hit[0] and _misspelled(word, self.entries[hit[1]]) in self.spared):
                self.hits[form] = hit
        self.seen.update(new)
        return lists

    def features(self, texts: list[bytes]) -> np.ndarray:
        """(evidence, evidence to length, any hit) of each text."""
        out = np.zeros((len(texts), 3))
        for i, words in enumerate(self.words(texts)):
            if self.hits.keys().isdisjoint(words):
                continue
            total = sum(self._weigh(words, k) for k, w in enumerate(words) if w in self.hits)
            out[i] = math.log1p(total), min(1.0, 20 * total / len(words)), min(1.0, total / 2)
        return out

    def _weigh(self, words: list[str], k: int) -> float:
        edits, entry = self.hits[words[k]]
        w = max(1.0, min(5.0, self.entries[entry].weight)) * (FUZZY if edits else 1.0)
        before, after = words[max(0, k - WINDOW):k], words[k + 1:k + 1 + WINDOW]
        marks = sum(x.count(q) for x in before + [words[k][:1]] for q in QUOTES)
        closes = any(q in x for x in [words[k][1:], *after] for q in QUOTES)
        if marks % 2 and closes or REPORTING.intersection(before):
            w *= QUOTED
        elif ADDRESS.intersection(before) or ADDRESS.intersection(after):
            w *= DIRECTED
        return w


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (intercept first) by Newton's method."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-3] + [l2] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _different(rows: DataFrame) -> DataFrame:
    """Each text once; toxic if any of its rows is."""
    return rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Model:
    rows = stage(_different(training_rows(docs, labels, "toxic", most)), "toxic-training")
    entries = lexicon(rows)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, frozenset())
        for batch in batches:
            texts = [t for t, y in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()) if not y]
            used: set[str] = set()
            for _, part in chunks(texts):
                used.update(_misspelled(_bare(w), entries[matcher.hits[w][1]]) for ws in matcher.words(part) for w in matcher.hits.keys() & set(ws) if matcher.hits[w][0])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(used), pa.string())], ["word"])

    spared = frozenset(r[0] for r in rows.mapInArrow(near, "word string").distinct().collect())  # of at most `most` documents

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, spared)
        for batch in batches:
            for at, part in chunks(batch.column(1).cast(pa.binary()).to_pylist()):
                f = matcher.features(part)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, len(part)), *[pa.array(f[:, j]) for j in range(3)]], ["label", "a", "b", "c"])

    x = rows.mapInArrow(measure, "label int, a double, b double, c double").toPandas().sort_values(["label", "a", "b", "c"])
    return Model(entries, spared, logistic(x[["a", "b", "c"]].to_numpy(), x["label"].to_numpy().astype(float)))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, ``__score`` and ``__toxic``."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy_worker():
            own = Model(*sent.value)
            matcher = Matcher(own.entries, own.spared)
            for batch in batches:
                for row in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(row, ROWS)
                    texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
                    for at, part in chunks(texts):
                        score = 1 / (1 + np.exp(-(own.weights[0] + matcher.features(part) @ own.weights[1:])))
                        rest = rows.slice(at, len(part))
                        rest = rest if returned else rest.drop_columns(["text"])
                        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score)], [*rest.schema.names, "score"])

    # columns travel under numbers, whatever their names; a text of strings travels once
    returned = docs.schema["text"].dataType == StringType()
    others = [f for f in docs.schema if not (returned and f.name == "text")]
    given = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)], F.col("text").cast("string").alias("text"))
    back = [StructField(f"c{i}", f.dataType) for i, f in enumerate(others)] + ([StructField("text", StringType())] if returned else [])
    out = given.mapInArrow(apply, StructType([*back, StructField("score", DoubleType())]))
    out = out.toDF(*[f.name for f in others], *(["text"] if returned else []), "__score")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "__score").withColumn("__toxic", F.col("__score") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns."""
    return scored(docs, fit(docs, labels)).filter("NOT __toxic").drop("__score", "__toxic")


@register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                       F.col("__score").alias("score"), F.col("__toxic").cast("int").alias("predicted"))
