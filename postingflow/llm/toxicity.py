"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; every model sees the text's
features and the probabilities of the categories before it.  In training those
are out-of-fold predictions, so a later model meets the earlier ones as wrong
as they will be on new texts.  The cut on the last category's probability is
the one with the best out-of-fold F1.

The label table has one label; the categories before it are two kinds of toxic
text found in the labelled sample: the first principal direction of the toxic
rows, over the features that speak for toxicity, parts rows whose features occur
together from the others.  No word list is used, so any vocabulary or language
that is labelled can be learned.

Features are presences of words and of word beginnings (lower case, by hash).
The models are fitted on a bounded sample of labelled rows (``SAMPLE`` rows of
either label, chosen by hash of the id); which features they use is decided by
a chi-square statistic counted in Spark over that sample.  Scoring is a map
over all documents and their whole texts.

Edge cases: a null or wordless text scores the model's value for "no feature
seen"; a labelled row without document, with a null id or a null label is not
learned from; repeated label rows count once with the largest label; without
labelled rows of both kinds nothing is toxic (all probabilities 0); an empty
table gives an empty result; other columns of the input pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .sizing import written

SAMPLE = 2000
FEATURES = 512
FOLDS = 5
RIDGE = 1.0
THRESHOLD = 0.5
#: Beginnings of so many bytes count as features beside the whole word.
PREFIXES = (3, 4, 5, 6, 7)
_WHOLE = np.uint64(0x5851F42D4C957F2D)

CATEGORIES = ("first_kind", "second_kind", "toxic")


def word_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, document) of every word and word beginning, repeats included."""
    starts, ends, first = tb.word_spans(raw, off, tb.LOWER_ALNUM)
    doc = tb.document_of(first)
    hashes = [tb.word_hashes(raw, starts, ends) ^ _WHOLE]
    docs = [doc]
    for n in PREFIXES:
        long = ends - starts >= n
        hashes.append(tb.word_hashes(raw, starts[long], starts[long] + n))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def _lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    text = pc.utf8_lower(batch.column("text").cast(pa.string()))
    return batch.set_column(batch.schema.get_field_index("text"), "text", text)


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[new], docs[new]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sample rows with their distinct features."""
    for batch in batches:
        low = _lowered(batch)
        for a, b, off, raw in tb.blocks(low):
            h, doc = _distinct(*word_features(raw, off))
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(a, b - a), batch.column("label").slice(a, b - a), lists],
                names=["id", "label", "features"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the unpenalised intercept) by Newton's method."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """One weight vector per category, and the last category's out-of-fold probabilities.

    Earlier categories enter the later models by their out-of-fold probabilities.
    """
    models, seen = [], x
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(logistic(seen, y))
        out = np.empty(len(y))
        for f in np.unique(fold):
            held = fold == f
            out[held] = predict(logistic(seen[~held], y[~held]), seen[held]) if (~held).any() else y.mean()
        seen = np.hstack((seen, out[:, None]))
    return models, out


def kinds(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Two columns that part the toxic rows by the first principal direction of their
    features (those more frequent in toxic rows); rows on neither side are of no kind."""
    side = np.zeros(len(x))
    speaks = x[toxic].mean(0) > x[~toxic].mean(0)
    if speaks.any():
        rows = x[toxic][:, speaks]
        rows = rows - rows.mean(0)
        direction = np.linalg.svd(rows, full_matrices=False)[2][0]
        direction = direction * np.sign(direction[np.argmax(np.abs(direction))])
        side[toxic] = np.round(rows @ direction, 9)
    return np.column_stack((side > 0, side < 0))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Cut with the largest weighted F1 out of fold, within 0.25 to 0.75; of equal ones the middle."""
    values = np.unique(np.concatenate((p, [0.0, 1.0])))
    cuts = (values[:-1] + values[1:]) / 2
    f1 = [2 * weight[(p >= c) & (y > 0)].sum() / max(1e-9, weight[p >= c].sum() + weight[y > 0].sum()) for c in cuts]
    best = np.flatnonzero(np.round(f1, 9) == np.round(max(f1), 9))
    return float(np.clip(cuts[best[len(best) // 2]], 0.25, 0.75))


class Chain:
    """Selected features, the chain's weights, and the cut for the last category."""

    def __init__(self, features: np.ndarray, models: list[np.ndarray], threshold: float = THRESHOLD):
        self.threshold = threshold
        order = np.argsort(features)
        self.features = features[order]
        n = len(features)
        # Weights of the text's features, of the earlier probabilities, and the intercept.
        self.text = np.column_stack([m[:n][order] for m in models]) if models else np.zeros((0, 0))
        self.earlier = [m[n:-1] for m in models]
        self.intercept = [m[-1] for m in models]
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of every category for every document of a block."""
        n = len(off) - 1
        out = np.zeros((n, len(self.intercept)))
        total = np.zeros((n, len(self.intercept)))
        if len(self.features) and len(raw):
            h, doc = word_features(raw, off)
            maybe = self.near[(h & np.uint64(0xFFFF)).astype(np.int64)]
            h, doc = h[maybe], doc[maybe]
            at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            known = self.features[at] == h
            pair = np.unique(doc[known] * len(self.features) + at[known])
            doc, at = pair // len(self.features), pair % len(self.features)
            for k in range(out.shape[1]):
                total[:, k] = np.bincount(doc, self.text[at, k], n)
        for k in range(out.shape[1]):
            z = total[:, k] + out[:, :k] @ self.earlier[k] + self.intercept[k]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def sample_rows(labelled: DataFrame, label: Column, n: int = SAMPLE) -> DataFrame:
    """At most ``n`` rows with the label and ``n`` without, first by hash of the id."""
    order = F.xxhash64(F.col("id"), F.lit("toxicity"))
    parts = [labelled.where(c).orderBy(order, "id").limit(n) for c in (label, ~label)]
    return parts[0].unionByName(parts[1])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
          label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES) -> Chain:
    """Fit the chain on a bounded sample of the labelled documents."""
    marked = (labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
              .dropna().groupBy("id").agg(F.max("label").alias("label")))
    chosen = sample_rows(marked, F.col("label") > 0, sample)  # 2 * sample rows at most
    share = marked.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0]
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", (F.col("label") > 0).cast("int").alias("label"))
    seen = written(rows.mapInArrow(_featured, "id long, label int, features array<long>"), "toxicity-sample")
    size = seen.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    if not size.n or not size.pos or size.pos == size.n:
        return Chain(np.zeros(0, np.uint64), [])
    n, pos = float(size.n), float(size.pos)
    count = seen.select(F.explode("features").alias("feature"), F.col("label").alias("y")) \
        .groupBy("feature").agg(F.count("*").alias("c"), F.sum("y").alias("t"))
    expected = F.col("c") * (pos / n)
    chi = (F.col("t") - expected) ** 2 / (expected * (1 - pos / n) * (1 - F.col("c") / n) + 0.5)
    best = np.array([r.feature for r in count.where("c >= 3").orderBy(F.desc(chi), "feature").limit(features).collect()],
                    np.int64).view(np.uint64)
    kept = F.array_intersect("features", F.array(*(F.lit(int(x)) for x in np.sort(best.view(np.int64)))))
    data = seen.select("id", "label", kept.alias("features")).orderBy("id").collect()
    column = {int(f): i for i, f in enumerate(best.view(np.int64))}
    x = np.zeros((len(data), len(best)))
    for i, r in enumerate(data):
        x[i, [column[f] for f in r.features]] = 1
    fold = (tb.mix64(np.array([r.id for r in data], np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    last = np.array([r.label for r in data])
    models, p = fit_chain(x, np.column_stack((kinds(x, last > 0), last)), fold)
    # The sample is balanced, the labelled rows are not.
    weight = np.where(last > 0, share * n / pos, (1 - share) * n / (n - pos))
    return Chain(best, models, best_threshold(p, last, weight))


def _score(model, row: pa.DataType, names: tuple[str, ...]):
    schema = pa.schema([("row", row), ("p", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        for batch in batches:
            for a, b, off, raw in tb.blocks(_lowered(batch)):
                p = chain.score(raw, off)
                if not p.shape[1]:
                    p = np.zeros((b - a, len(names)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * len(names), pa.int32()),
                                                 pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a).cast(row), lists], schema=schema)
    return run


def score(docs: DataFrame, model: Chain, text: str = "text") -> DataFrame:
    """Rows (row, p): the input row as a struct, the probabilities in the order of CATEGORIES."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType
    sent = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(sent, to_arrow_type(kind), CATEGORIES),
                           f"row {kind.simpleString()}, p array<double>")
