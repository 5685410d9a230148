"""Language identification with a string kernel.

Texts are compared by the character n-grams that they hold (blended spectrum:
every length from 1 to ``MAX_N``; presence, not counts). The kernel of two texts is the
number of shared n-grams over the geometric mean of their numbers, taken over the
n-grams of the landmarks. A Nystroem map through the landmarks turns it into
features, and one ridge regression per language scores them. Scoring is two
matrix products per batch: presence by landmarks, then landmarks by languages.

The classifier is fitted on a bounded sample of labelled rows; every row is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_N = 3
HASH_BITS = 20
# The sample: so many labelled rows of each language at most, those whose texts
# have the smallest hashes, and so many landmarks over all languages.
ROWS_PER_LABEL = 400
LANDMARKS = 128
RIDGE = 0.1
# More labels than this are taken for an error in the label column.
MAX_LABELS = 500
UNDETERMINED = "und"
# A text resembles a label if landmarks hold so much of what they hold of that label's median learned row.
RESEMBLES = 0.25

# A batch's presence matrix and the characters looked at in one go.
MATRIX_CELLS = 1 << 21
SEGMENT = 1 << 19

OUTPUT = "lang_pred string, score double"


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each code point but the last n - 1."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint32)
    h = codes[:count].astype(np.uint64)
    for j in range(1, n):
        h = h * np.uint64(0x100000001B3) + codes[j : j + count]
    h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_set(text: str, max_n: int = MAX_N) -> np.ndarray:
    """The distinct n-gram hashes of a text, sorted; at most 2**HASH_BITS."""
    seen = np.zeros(1 << HASH_BITS, dtype=bool)
    codes = code_points(text)
    for at in range(0, len(codes), SEGMENT):
        part = codes[at : at + SEGMENT + max_n - 1]
        for n in range(1, max_n + 1):
            seen[gram_hashes(part, n)] = True
    return np.flatnonzero(seen).astype(np.uint32)


def longest_grams(text: str, max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a text's n-grams of the greatest length, and how often each occurs."""
    seen = np.zeros(1 << HASH_BITS, dtype=np.int64)
    codes = code_points(text)
    for at in range(0, len(codes), SEGMENT):
        found, times = np.unique(gram_hashes(codes[at : at + SEGMENT + max_n - 1], max_n), return_counts=True)
        seen[found] += times
    grams = np.flatnonzero(seen)
    return grams.astype(np.uint32), seen[grams]


@dataclass
class Model:
    """Landmark n-grams, their weights towards each landmark, and landmarks' weights towards each label."""

    labels: list[str]
    column: np.ndarray  # of each hash, or -1
    landmarks: np.ndarray  # n-grams x landmarks
    weights: np.ndarray  # landmarks x labels
    bias: np.ndarray
    max_n: int = MAX_N
    floors: np.ndarray | None = None  # of each label, the least share a text must have to resemble it

    @property
    def width(self) -> int:
        return len(self.landmarks)

    def kernel(self, present: np.ndarray) -> np.ndarray:
        """Kernel values of texts, as rows of presence, with the landmarks."""
        size = np.maximum(present.sum(axis=1, keepdims=True), 1)
        return (present @ self.landmarks) / np.sqrt(size)

    def scores(self, present: np.ndarray) -> np.ndarray:
        return self.kernel(present) @ self.weights + self.bias

    def share(self, text: str) -> float:
        """How much of a text's n-grams of the greatest length, repeats counted, the landmarks hold; 1 if it has none.

        Unlike the scores, whose sum over the labels is the same for every text, it is low for what no label resembles.
        """
        codes, held, count = code_points(text), 0, 0
        for at in range(0, len(codes), SEGMENT):
            found = self.column[gram_hashes(codes[at : at + SEGMENT + self.max_n - 1], self.max_n)]
            held, count = held + int((found >= 0).sum()), count + len(found)
        return held / count if count else 1.0

    def presence(self, texts: list[str]) -> np.ndarray:
        present = np.zeros((len(texts), self.width), dtype=np.float32)
        for row, codes in enumerate(map(code_points, texts)):
            for at in range(0, len(codes), SEGMENT):
                part = codes[at : at + SEGMENT + self.max_n - 1]
                for n in range(1, self.max_n + 1):
                    found = self.column[gram_hashes(part, n)]
                    present[row, found[found >= 0]] = 1
        return present


def fit_sets(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, max_n: int = MAX_N, longest: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Model:
    """Fit on n-gram sets and their labels. Landmarks are the first sets of each label, in turn.

    With the rows' ``longest_grams`` a floor is learned for each label; a landmark's own n-grams don't count for it.
    """
    names = sorted(set(labels))
    queues = [[i for i, x in enumerate(labels) if x == name] for name in names]
    turns = [q[k] for k in range(max(map(len, queues))) for q in queues if k < len(q)]
    chosen = turns[: max(landmarks, len(names))]

    grams = np.unique(np.concatenate([sets[i] for i in chosen]))
    column = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    column[grams] = np.arange(len(grams))

    def rows(which: list[int]) -> np.ndarray:
        out = np.zeros((len(which), len(grams)), dtype=np.float32)
        for r, i in enumerate(which):
            found = column[sets[i]]
            out[r, found[found >= 0]] = 1
        return out

    own = rows(chosen)
    own /= np.sqrt(np.maximum(own.sum(axis=1, keepdims=True), 1))
    model = Model(names, column, np.ascontiguousarray(own.T), np.empty(0), np.empty(0), max_n)

    values, vectors = np.linalg.eigh((own @ own.T).astype(np.float64))
    kept = values > 1e-8 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    blocks = [model.kernel(rows(turns[at : at + 256])) for at in range(0, len(turns), 256)]
    features = np.concatenate(blocks).astype(np.float64) @ root
    target = np.where(np.array([labels[i] for i in turns])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    middle, level = features.mean(axis=0), target.mean(axis=0)
    centred = features - middle
    solved = np.linalg.solve(centred.T @ centred + ridge * np.eye(centred.shape[1]), centred.T @ (target - level))
    model.weights = (root @ solved).astype(np.float32)
    model.bias = (level - middle @ solved).astype(np.float32)
    if longest is not None:
        holders, shares = (own > 0).sum(axis=0), {name: [] for name in names}
        for r, i in enumerate(turns):
            found, times = column[longest[i][0]], longest[i][1]
            others = np.where(found >= 0, holders[found], 0) - (r < len(chosen))
            if len(times):
                shares[labels[i]].append(times[others > 0].sum() / times.sum())
        model.floors = np.array([RESEMBLES * np.median(shares[name]) if shares[name] else 0.0 for name in names])
    return model


def fit(
    labelled: DataFrame,
    text: str = "text",
    label: str = "lang",
    rows_per_label: int = ROWS_PER_LABEL,
    landmarks: int = LANDMARKS,
    ridge: float = RIDGE,
) -> Model | None:
    """Fit on at most ``rows_per_label`` rows of each label; None if no row has both a label and a letter.

    The sample depends on the texts alone, not on how rows lie in files. Only hashes
    move to find its bound; then the sampled rows' n-gram sets come to the driver,
    at most ``rows_per_label`` a label plus ties of one hash, each of at most 2**HASH_BITS hashes.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    hashed = rows.withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("label").orderBy("h")
    # Equal texts are one candidate, so that a large group of copies can't fill the sample.
    ranked = hashed.select("label", "h").distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows_per_label)
    bounds = ranked.groupBy("label").agg(F.max("h").alias("top")).limit(MAX_LABELS + 1).collect()
    if len(bounds) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not bounds:
        return None
    inside = [(F.col("label") == r.label) & (F.col("h") <= r.top) for r in bounds]
    chosen = inside[0]
    for x in inside[1:]:
        chosen = chosen | x

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [gram_set(t).tobytes() for t in batch["text"]]
            longest = [tuple(x.tobytes() for x in longest_grams(t)) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "h": batch["h"], "grams": grams, "long": [x for x, _ in longest], "times": [x for _, x in longest]})

    found = hashed.filter(chosen).mapInPandas(sets, "label string, h long, grams binary, long binary, times binary")
    sample = found.groupBy("label", "h").agg(F.first(F.struct("grams", "long", "times")).alias("x")).select("label", "h", "x.*").orderBy("label", "h").collect()
    longest = [(np.frombuffer(r.long, dtype=np.uint32), np.frombuffer(r.times, dtype=np.int64)) for r in sample]
    return fit_sets([np.frombuffer(r.grams, dtype=np.uint32) for r in sample], [r.label for r in sample], landmarks, ridge, longest=longest)


def predict(docs: DataFrame, model: Model | None, text: str = "text", resembling: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, the best label's regression value mapped from -1..1).

    A null text, one without letters, and every text if there is no model: ``und``
    with score 0. With ``resembling`` also a text whose share is under the floor of its best label. Ties go to the first label in order. All columns of ``docs`` are kept;
    columns named lang_pred or score are replaced; repeated rows are scored each; no rows give no rows.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        fitted = shared.value
        step = max(1, MATRIX_CELLS // max(1, fitted.width)) if fitted else 1
        for batch in batches:
            texts = batch.column(text).to_pylist()
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if fitted and t and any(map(str.isalpha, t))]
            for at in range(0, len(known), step):
                part = known[at : at + step]
                values = fitted.scores(fitted.presence([texts[i] for i in part]))
                for i, best, value in zip(part, values.argmax(axis=1), values.max(axis=1)):
                    if resembling and fitted.floors is not None and fitted.share(texts[i]) < fitted.floors[best]:
                        continue
                    names[i] = fitted.labels[best]
                    scores[i] = float(min(1.0, max(0.0, (1 + value) / 2)))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*kept).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are kept for testing: the id's crc32 leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
