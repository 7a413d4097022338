"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or of
them scores the document, and only documents are labelled."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Labelled documents that the model is fitted on at most, by smallest hash.
SAMPLE = 5000
#: Characters that these hold together: the sample ends, in that order of hashes,
#: before the row that would exceed them (the first row is taken whatever its length).
SAMPLE_CHARS = 64_000_000
#: Features kept, those that separate the labelled documents best.
FEATURES = 4096
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: What the logistic of a sentence's evidence has to exceed to count at all, in
#: training as in scoring, else the many clean sentences of a long document add up.
FLOOR = 0.06
SENTENCE = re.compile(r"[^.!?\n]+")
PUNCTUATION = "'\"()[]{}<>,;:*_-#%&$|/\\~`"


def features(word: str) -> list[str]:
    """A word itself and, of longer words, its first letters."""
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) > n)]


def words(text: str) -> list[str]:
    return [w for w in (x.strip(PUNCTUATION) for x in text.lower().split()) if w]


class Model:
    """weights by feature, the bias of a sentence and the leak: the chance that
    a document without any evidence is labelled."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.weights, self.bias, self.leak)

    def weight(self, word: str) -> float:
        if (w := self.known.get(word)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            w = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word.strip(PUNCTUATION)) if word)
        return w

    def sentence(self, text: str) -> float:
        """0 without evidence, near 1 for a sentence that is surely toxic."""
        return self.chance(sum(map(self.weight, text.lower().split())))

    def chance(self, evidence: float) -> float:
        if evidence <= 0:
            return 0.0
        return max(0.0, (1 / (1 + math.exp(-min(self.bias + evidence, 30))) - FLOOR) / (1 - FLOOR))

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The score and (start, end, score) of every sentence with evidence."""
        clean, spans = 1 - self.leak, []
        if any(map(self.weight, text.lower().split(None))) or any(c in text for c in "!?."):
            for m in SENTENCE.finditer(text):
                if (p := self.sentence(m.group())) > 0:
                    clean *= 1 - p
                    spans.append((m.start(), m.end(), p))
        return 1 - clean, spans


def fit(texts: list[str], labels: list[int], rounds: int = 40, rate: float = 0.5, decay: float = 1e-2) -> Model:
    """Noisy-or multiple-instance logistic model, by gradient ascent.

    A sentence's gradient is its share of the document's probability, so a
    positive document teaches its likeliest sentences only.
    """
    toxic = sum(labels)
    if not toxic or toxic == len(labels):
        return Model({}, -8.0, toxic / len(labels) if labels else 0.0)
    in_one, clean = Counter(), Counter()
    for t, label in zip(texts, labels, strict=True):
        if label:
            in_one.update({f for w in set(words(t)) for f in features(w)})
    for t, label in zip(texts, labels, strict=True):
        if not label:
            clean.update({f for w in set(words(t)) for f in features(w) if f in in_one})
    odds = {f: math.log((n + 0.1) / (toxic + 0.2)) - math.log((clean[f] + 0.5) / (len(labels) - toxic + 1)) for f, n in in_one.items() if n >= max(3, toxic / 100)}
    chosen = sorted((f for f in odds if odds[f] > 1.5), key=lambda f: (-in_one[f] * odds[f], f))[:FEATURES]
    place = {f: i for i, f in enumerate(chosen)}
    feature, sentence, owner = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for s in SENTENCE.findall(t):
            if hit := {place[f] for w in words(s) for f in features(w) if f in place}:
                feature.extend(hit)
                sentence.extend([len(owner)] * len(hit))
                owner.append(d)
    feature, sentence, owner = (np.array(x, np.int32) for x in (feature, sentence, owner))
    y = np.array(labels, float)
    bare = np.ones(len(y), bool)
    bare[owner] = False
    leak = float(np.clip((y[bare].sum() + 0.5) / (bare.sum() + 10), 1e-3, 0.2))
    w, b = np.array([min(odds[f], 4.0) for f in chosen]), -4.0
    speed = np.full(len(w), 1e-6)
    for _ in range(rounds):
        z = b + np.bincount(sentence, w[feature], len(owner))
        raw = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p = np.clip((raw - FLOOR) / (1 - FLOOR), 0, 1 - 1e-9)
        clean = np.exp(np.bincount(owner, np.log1p(-p), len(y))) * (1 - leak)
        whole = np.clip(1 - clean, 1e-9, 1 - 1e-9)
        slope = np.where(y[owner] == 1, clean[owner] / whole[owner], -1.0) / (1 - p) * raw * (1 - raw) / (1 - FLOOR) * (p > 0)
        step = np.bincount(feature, slope[sentence], len(w)) - decay * w
        speed += step * step
        w = np.maximum(w + rate * step / np.sqrt(speed), 0)
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if x > 1e-3}, b, leak)


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2: rows whose label is never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most SAMPLE labelled rows of SAMPLE_CHARS characters in all
    that are not held out, those with the smallest hash of their id.

    Defined results: rows without text, label or id don't count; of an id with
    several labels the larger one does; rows that repeat an id count each; with
    no labelled text, or one class only, the model knows no words and scores
    every text by that class's share; other columns are ignored.
    """
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~is_held_out(F.col("id")))
    picked = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    # picked has SAMPLE rows of two numbers at most, whatever the tables hold
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(picked), "id")
    texts = texts.select(F.xxhash64("id", "text").alias("row"), F.xxhash64("id").alias("h"), "id", "text", "y")
    order = ["h", "id", "row"]
    sizes = texts.select(*order, F.char_length("text").alias("chars")).orderBy(*order).limit(SAMPLE).collect()
    held, n = 0, 0
    for r in sizes:
        held += r["chars"]
        if held > SAMPLE_CHARS and n:
            break
        n += 1
    rows = texts.orderBy(*order).limit(n).select("text", "y").collect() if n else []
    return fit([r["text"] for r in rows], [int(r["y"] > 0) for r in rows])


SPANS = "array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1) and sentences: where evidence lies and how strong.

    Defined results: a null, empty or wordless text gets the leak as its score
    and no sentences; texts of any length are scored whole; repeated rows are scored each; ids of any type and null
    pass through; other columns are ignored; an empty table gives an empty
    table. The text is the only input of a score. One pass, no shuffle.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.document(t.as_py() or "") for t in batch.column(1)]
            flat = [span for _, spans in got for span in spans]
            parts = [pa.array([span[k] for span in flat], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))]
            ends = pa.array(np.cumsum([0, *(len(spans) for _, spans in got)]), pa.int32())
            spans = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["start", "end", "score"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.float64()), spans], names=["id", "score", "sentences"])

    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    out = rows.mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double, sentences {SPANS}")
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, less the rows whose score reaches the threshold.

    Defined results: a null, empty or wordless text scores the leak; texts of
    any length are scored whole; repeated rows go or stay alike; all columns
    pass through; an empty table gives an empty table.
    """

    @F.pandas_udf("double")
    def toxic(texts):
        return texts.map(lambda t: model.document(t or "")[0])

    return docs.where(toxic(quoted(text_col)) < threshold)
