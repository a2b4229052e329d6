"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word stems (first letters) that labelled toxic texts hold far more often than others.
Features of a whole text are densities of lexicon hits, hits that appear once obfuscation is undone, closeness of hits
to second-person words, capitals, punctuation and obfuscation rates, and length. Trees are fitted on part of a bounded
sample of labelled rows, calibration on the rest of it; then every text is scored in one pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.boosting import BoostedTrees, isotonic
from lattica.llm.common import staged, unused, whole

#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ya thou thee du dich dir dein deine deiner euch ihr sie tu te toi vous ton ta tes votre vos tú ti tus usted ustedes vosotros vuestra vuestro".split())
#: Characters that stand in for letters.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
WORD = re.compile(r"[^\W\d_]+")
#: What a run of non-blanks of bounded length looks like if characters stand in for letters, or lie between them.
ODD = re.compile(r"[^\W\d_]\S*[\d@$!*|._-]+[^\W_]")
ODD_SIZES = range(3, 41)
MARKS = re.compile(r"[^\w\s]")
STEM, STEM_FROM, NEAR = 5, 6, 8
FEATURES = ("hits", "stem_hits", "heaviest", "weight", "density", "stem_density", "hidden_hits", "nearness", "you", "capitals", "shouted", "marks", "cries", "odd", "digits", "long", "words")


def terms(text: str) -> set[str]:
    """What the lexicon may hold: the words of a text, and the stems of longer ones (written with a dash)."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:STEM] + "-" for w in words if len(w) >= STEM_FROM}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = WORD.findall(text.lower())
    n, size = max(1, len(words)), max(1, len(text))
    get = lexicon.get
    hits = [(i, v) for i, w in enumerate(words) if (v := get(w))]
    stems = [(i, v) for i, w in enumerate(words) if len(w) >= STEM_FROM and (v := get(w[:STEM] + "-"))]
    odd = [w for w in text.split() if not w.isalpha() and len(w) in ODD_SIZES and ODD.search(w)]
    hidden = sum(1 for w in odd if get(re.sub(r"[^a-zà-ÿ]", "", w.lower().translate(STAND_INS))) and not get(w.lower()))
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    both = hits + stems
    near = 0
    if both and you:
        at = np.array([-len(words) - NEAR, *you, 2 * len(words) + NEAR])
        places = np.array([i for i, _ in both])
        after = np.searchsorted(at, places)
        near = int((np.minimum(at[after] - places, places - at[after - 1]) <= NEAR).sum())
    weight = sum(v for _, v in both)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    marks = len(MARKS.findall(text))
    return [
        len(hits), len(stems), max((v for _, v in both), default=0.0), weight, len(hits) / n, len(stems) / n, hidden, near / max(1, len(both)), len(you) / n,
        upper / size, sum(1 for w in WORD.findall(text) if len(w) > 2 and w.isupper()) / n if upper > 3 else 0.0, marks / size, (text.count("!") + text.count("?")) / size, len(odd) / n,
        sum(map(text.count, "0123456789")) / size, sum(map(len, words)) / n, np.log1p(len(words)),
    ]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels are never learned: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class ToxicityModel:
    """A lexicon, trees and a calibration; small, and sent to the workers as it is."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees | None, centres: np.ndarray, means: np.ndarray, prior: float):
        self.lexicon, self.trees, self.centres, self.means, self.prior = lexicon, trees, centres, means, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts], float).reshape(len(texts), len(FEATURES)))
        steps = np.interp(margin, self.centres, self.means)
        return np.clip(0.999 * steps + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)  # the small part orders what one step holds


def learn_lexicon(sample: DataFrame, *, least: int = 3, most: int = 400, weight: float = 1.5) -> dict[str, float]:
    """Terms with their log odds between toxic and other texts of ``sample`` (text, toxic); ``most`` of each kind."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update(terms(text))
            rows = [(t, found[1][t], found[0][t]) for t in found[0] | found[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["term", "toxic", "other"])

    totals = sample.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("other")).first()
    counts = sample.select("text", "toxic").mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (totals["toxic"] + 1)) - F.log((F.col("other") + 0.5) / (totals["other"] + 1))
    counts = counts.filter(F.col("toxic") >= max(least, totals["toxic"] // 100)).withColumn("odds", odds).filter(F.col("odds") >= weight)
    lexicon: dict[str, float] = {}
    for kind in (F.col("term").endswith("-"), ~F.col("term").endswith("-")):
        lexicon |= {r["term"]: r["odds"] for r in counts.filter(kind).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(most).collect()}
    return lexicon


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_per_class: int = 4000, min_per_class: int = 8) -> ToxicityModel:
    """Learns from at most ``max_per_class`` labelled documents of either class, those with the smallest hashes.

    Held-out documents and rows without a label, a doc_id or a text give nothing to learn from. With fewer than
    ``min_per_class`` of a class the score of every text is the share of toxic labels (0 without labels).
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    marks = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = marks.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("other")).first()
    prior = totals["toxic"] / max(1, totals["toxic"] + totals["other"])
    picked = [marks.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for t in (0, 1)]
    # two times max_per_class rows of two numbers at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    sample = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    sample = staged(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4))), "labelled")
    lexicon = learn_lexicon(sample.filter("fold > 0"))  # the calibration fold tells nothing, or it would be too sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("fold"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "toxic", "fold", "x"])

    rows = sample.mapInArrow(run, "doc_id long, toxic int, fold long, x array<double>").orderBy("doc_id", "toxic", "x").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if min((y == 1).sum(), (y == 0).sum()) < min_per_class:
        return ToxicityModel(lexicon, None, np.zeros(1), np.zeros(1), prior)
    x, fold = np.array([r["x"] for r in rows], float), np.array([r["fold"] for r in rows])
    w = np.where(y == 1, totals["toxic"] / (y == 1).sum(), totals["other"] / (y == 0).sum())  # as if all labels had been taken
    w /= w.mean()
    fit = fold > 0
    if min((y[fit] == 1).sum(), (y[fit] == 0).sum(), (y[~fit] == 1).sum(), (y[~fit] == 0).sum()) == 0:
        fit = np.ones(len(y), bool)
    trees = BoostedTrees().fit(x[fit], y[fit], w[fit])
    rest = ~fit if (~fit).any() else fit
    centres, means = isotonic(trees.margin(x[rest]), y[rest], w[rest])
    return ToxicityModel(lexicon, trees, centres, means, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """``docs`` (all columns) with a score from 0 to 1. Null texts count as empty; an empty table stays empty.

    If a column is called ``name`` already, it stays and underscores are appended to the name of the score.
    """

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series(model.scores(some.tolist()))

    return docs.withColumn(unused(name, docs.columns), scored(whole(F.col("text"))))


def toxicity_of_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
