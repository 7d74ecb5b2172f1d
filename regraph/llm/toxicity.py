"""Toxicity: a counterfactually regularised linear classifier over whole texts.

Features are hashed lower-case words, each with the value 1 + ln(count in the text). The loss is
weighted logistic loss + l1 / sqrt(n) * |w| + l2 * |w|^2 and a counterfactual term: in every labelled text
that holds an identity term, the term is swapped for each other term of its group, and the squared
change of the score (logit) is penalised; the lexicon's own pairs are added once, so terms that no
labelled text holds are tied as well. A neutral mention of a group therefore moves the score as
little as a mention of any other group, and, as the groups include the empty mention (weight 0),
hardly at all.

Fitting uses a bounded sample: the SAMPLE labelled documents whose hashed doc_id is smallest, and
runs in NumPy on the driver over their hashed features. Scoring covers every document in Arrow
batches; the only thing sent out is the weight vector of 2^BITS floats.

Nulls, ties, odd input: a null or empty text has the score of no words (the intercept); a null
label is left out of the fit; a document labelled twice counts twice; equal rows get equal scores;
with no labels, or labels of one kind only, every score is that class's smoothed rate; very long texts
are scored whole; an empty table gives no rows; `drop_toxic` keeps further columns of any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices, unused, word_hashes, words_of

#: Groups of neutral identity terms (fixed values); members of a group may stand for each other.
IDENTITY_GROUPS = [
    ["women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender", "nonbinary"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "muslims", "christians", "jews", "hindus"],
    ["black", "white", "asian", "latino", "african", "european", "hispanic", "arab"],
    ["gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"],
    ["immigrants", "refugees", "citizens", "foreigners", "natives"],
    ["disabled", "blind", "deaf", "autistic", "elderly", "young"],
    ["frauen", "männer", "frau", "mann", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "hindus", "atheisten"],
    ["ausländer", "flüchtlinge", "einwanderer", "einheimische"],
    ["femmes", "hommes", "femme", "homme", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "hindous", "athées"],
    ["étrangers", "réfugiés", "immigrés", "citoyens"],
    ["mujeres", "hombres", "mujer", "hombre", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "ateos"],
    ["extranjeros", "refugiados", "inmigrantes", "ciudadanos"],
    ["женщины", "мужчины", "женщина", "мужчина"],
    ["мусульмане", "христиане", "евреи", "атеисты"],
]
BITS, SAMPLE, ROUNDS, L1, L2, COUNTERFACTUAL, MIN_DOCS = 18, 16_000, 200, 0.06, 1e-6, 1.0, 3


def folded(vocabulary: pa.Array) -> pa.Array:
    """Words lower-cased without punctuation at either end; words of punctuation alone stay."""
    low = pc.utf8_lower(vocabulary)
    bare = pc.replace_substring_regex(low, r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    return pc.if_else(pc.equal(pc.binary_length(bare), 0), low, bare)


def slots_of(words: pa.Array) -> np.ndarray:
    return (word_hashes(words, 4) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the distinct slots of each text."""
    offsets, codes, vocabulary = words_of(texts)
    slot = slots_of(folded(vocabulary))[codes] if len(codes) else codes
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key, count = np.unique((row << BITS) | slot, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), 1 + np.log(count)


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def logits(self, row: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.weights[slot] * value, n) + self.intercept


def fit(row: np.ndarray, slot: np.ndarray, value: np.ndarray, label: np.ndarray, counterfactual: float = COUNTERFACTUAL, rounds: int = ROUNDS) -> Model:
    """Accelerated proximal gradient descent; labels of the rarer class weigh up to four times as much."""
    n, size = len(label), 1 << BITS
    positive = int(label.sum())
    if not n or positive in (0, n):
        return Model(np.zeros(size), float(np.log((positive + 1) / (n - positive + 1))))
    seen = np.bincount(slot, minlength=size)
    used = np.flatnonzero(seen >= MIN_DOCS)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    keep = place[slot] >= 0
    row, col, value = row[keep], place[slot[keep]], value[keep]
    weight = np.where(label == 1, min(4.0, (n - positive) / positive), 1.0)
    weight = weight / weight.sum()
    pairs = counterfactual_pairs(row, col, value, place, n)
    w, b = np.zeros(len(used)), float(np.log(positive / (n - positive)))
    # a separable bound of the curvature gives each coordinate its own step, with no line search
    total = np.bincount(row, value, n) + 1
    bound = np.bincount(col, (weight * total)[row] * value, len(used)) / 4 + 2 * L2
    for (i, j), m in pairs.items():
        for k in (i, j):
            if k >= 0:
                bound[k] += 4 * counterfactual * m
    step, step_b = 1 / bound, 4 / float((weight * total).sum())
    l1 = L1 / np.sqrt(n)
    y, c, t = w, b, 1.0
    for _ in range(rounds):
        z = np.bincount(row, y[col] * value, n) + c
        r = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label)
        g = np.bincount(col, r[row] * value, len(used)) + 2 * L2 * y
        for (i, j), m in pairs.items():
            d = 2 * counterfactual * m * ((y[i] if i >= 0 else 0) - (y[j] if j >= 0 else 0))
            if i >= 0:
                g[i] += d
            if j >= 0:
                g[j] -= d
        nw = y - step * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = c - step_b * float(r.sum())
        if float((y - nw) @ (bound * (nw - w))) > 0:  # the momentum points uphill: start it again
            t = 1.0
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    full = np.zeros(size)
    full[used] = w
    return Model(full, b)


def counterfactual_pairs(row, col, value, place, n) -> dict[tuple[int, int], float]:
    """Weight of (w_i - w_j)^2 for each pair of a group's columns; column -1 has weight 0.

    A text with term i at value v changes its logit by v * (w_j - w_i) when j takes i's place. Each
    pair also weighs once for the lexicon itself, and each term once against no mention.
    """
    out: dict[tuple[int, int], float] = {}
    squares = np.bincount(col, value**2, int(col.max(initial=-1)) + 1)
    for group in IDENTITY_GROUPS:
        cols = [int(place[s]) for s in slots_of(pa.array(group))]
        for a, i in enumerate(cols):
            mass = (squares[i] if 0 <= i < len(squares) else 0) / len(cols)
            for b, j in enumerate([*cols, -1]):
                if a != b and i != j:
                    key = (min(i, j), max(i, j))
                    out[key] = out.get(key, 0) + (mass + 1) / max(1, n)
    return {k: v for k, v in out.items() if k != (-1, -1)}


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled documents outside the held-out part."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # sorted by a hash, so the sample is one for all runs; at most `sample` small rows, so a broadcast
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    def hashed(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                row, slot, value = features(part.column("text"))
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("toxic"),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(slot.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(value.astype(np.float32))),
                ], names=["toxic", "slots", "vals"])

    got = labelled_sample(docs, labels, sample).mapInArrow(hashed, "toxic int, slots array<int>, vals array<float>").toArrow()
    label = got.column("toxic").to_numpy().astype(float)
    flat = lambda name: got.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(got) else np.zeros(0)
    count = pc.list_value_length(got.column("slots")).to_numpy() if len(got) else np.zeros(0, int)
    return fit(np.repeat(np.arange(len(label)), count), flat("slots").astype(np.int64), flat("vals").astype(float), (label > 0).astype(float))


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The kept columns of docs and, as `name`, the probability that a text is toxic."""
    from pyspark.sql import types as T

    weights = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))
    intercept = model.intercept
    schema, body = T.StructType([docs.schema[k] for k in keep] + [T.StructField(name, T.DoubleType())]), unused(docs, "_text")

    def run(batches):
        m = Model(weights.value.astype(float), intercept)
        for batch in batches:
            for part in text_slices(batch, body):
                p = 1 / (1 + np.exp(-m.logits(*features(part.column(body)), part.num_rows)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(p)], names=[*keep, name])

    return docs.select(*keep, F.col("text").cast("string").alias(body)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, with all their columns, without the texts scored at threshold or more."""
    model, name = train(docs, labels), unused(docs, "_score")
    return score(docs, model, docs.columns, name).where(F.col(name) < threshold).select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
