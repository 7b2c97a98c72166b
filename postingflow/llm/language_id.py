"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams (lengths 1 to ``N``, the
blended spectrum) present in both, over the root of the product of their
numbers of distinct n-grams.  Nyström landmarks (a few texts of every
language) turn a text into its kernel values with the landmarks, and
one-versus-rest kernel ridge regression on those gives a score per language.
Presence vectors of a batch of texts and of the landmarks meet in one matrix
product.

Texts are lower-cased, and everything but letters becomes a space.  n-grams
are hashed to ``DIMENSIONS`` places.  The model is fitted on a bounded sample
(``SAMPLE`` labelled texts of every language, of which ``LANDMARKS`` are
landmarks); every text is scored whole.

Edge cases: a null text, or one without a letter, is ``und`` with score 0;
without labelled texts every text is ``und``; a null id is never learned from;
repeated rows are predicted each; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

N = 4
DIMENSIONS = 1 << 15
SAMPLE = 200
LANDMARKS = 24
RIDGE = 1e-3
CHUNK = 128
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_BASES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_SYMBOL = np.where(tb.byte_class(ranges=((0x61, 0x7A), (0x80, 0xFF))),
                   np.arange(256, dtype=np.uint8), np.uint8(0x20)).astype(np.uint8)


def presence(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """0/1 matrix of the hashed n-grams present in every document of a block."""
    n = len(off) - 1
    out = np.zeros((n, DIMENSIONS), np.uint8)
    letters = tb._LETTERS[_SYMBOL[raw]]
    doc = np.repeat(np.arange(n), np.diff(off))
    flat = out.reshape(-1)
    for size, base in zip(range(1, N + 1), _BASES):
        if len(raw) < size:
            break
        h = tb.rolling(letters, size, base)
        first = doc[:len(h)]
        inside = first == doc[size - 1:]
        at = (h >> np.uint64(64 - 15)).astype(np.int64) + first * DIMENSIONS
        flat[at[inside]] = 1
    return out


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.string()).fill_null(""))


class Model:
    """Landmark presences and the regression weights of every language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages = languages
        size = np.sqrt(np.maximum(1, landmarks.sum(axis=1, dtype=np.int64)))
        self.landmarks = (landmarks / size[:, None]).T.astype(np.float32)
        self.weights = weights

    def kernel(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(1, x.sum(axis=1, dtype=np.int64)))
        return (x.astype(np.float32) @ self.landmarks) / size[:, None]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score in 0 to 1)."""
        k = self.kernel(x)
        z = np.hstack((k, np.ones((len(k), 1)))) @ self.weights
        z = np.exp(4 * (z - z.max(axis=1, keepdims=True)))
        z /= z.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        return best, z[np.arange(len(z)), best]


def fit(languages: list[str], x: np.ndarray, y: np.ndarray, marks: np.ndarray, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regression in the span of the landmarks.

    ``marks`` are the rows of ``x`` that become landmarks.  Minimises the
    squared error plus ridge times the norm of the function in the kernel's space.
    """
    model = Model(languages, x[marks], np.zeros((0, 0)))
    k = model.kernel(x).astype(np.float64)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    phi = np.hstack((k, np.ones((len(k), 1))))
    inner = np.zeros((phi.shape[1],) * 2)
    inner[:-1, :-1] = k[marks]
    curve = phi.T @ phi + ridge * len(k) * (inner + 1e-6 * np.eye(len(inner)))
    model.weights = np.linalg.solve(curve, phi.T @ target)
    return model


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = batch.set_column(batch.schema.get_field_index("text"), "text", lowered(batch.column("text")))
        for a, b, off, raw in tb.blocks(low):
            bits = [np.packbits(row).tobytes() for row in presence(raw, off)]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array(bits, pa.binary())],
                                             names=["id", "lang", "bits"])


def train(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Fit on about ``sample`` texts of every language among the rows where ``learn`` holds.

    Each text travels as its presence bits, so the driver's share is bounded by
    the number of languages.
    """
    rows = docs.where(learn).select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"),
                                    F.col(lang).cast("string").alias("lang")).dropna()
    rows = rows.where(F.col("text").rlike("\\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, DIMENSIONS), np.uint8), np.zeros((1, 0)))
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30))
    limit = F.create_map(*(F.lit(v) for k, n in sorted(counts.items())
                           for v in (k, min(1 << 30, int((1 << 30) * sample / n)))))
    data = sorted(rows.where(place < limit[F.col("lang")]).mapInArrow(_packed, "id long, lang string, bits binary")
                  .collect(), key=lambda r: (r.lang, r.id))
    languages = sorted({r.lang for r in data})
    x = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in data], np.uint8).reshape(len(data), DIMENSIONS)
    y = np.array([languages.index(r.lang) for r in data])
    marks = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))])
    return fit(languages, x, y, marks)


def _predict(sent, kind: pa.DataType):
    schema = pa.schema([("id", kind), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            low = batch.set_column(batch.schema.get_field_index("text"), "text", lowered(batch.column("text")))
            for lo in range(0, len(batch), CHUNK):
                for a, b, off, raw in tb.blocks(low.slice(lo, CHUNK)):
                    part = batch.slice(lo + a, b - a)
                    lang, score = [UNDETERMINED] * (b - a), np.zeros(b - a)
                    told = np.array([bool(_LETTER.search(t.as_py() or "")) for t in part.column("text")], bool)
                    if model.languages and told.any():
                        best, p = model.predict(presence(raw, off))
                        score = np.where(told, p, 0.0)
                        lang = [model.languages[k] if t else UNDETERMINED for k, t in zip(best, told)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").cast(kind), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                        schema=schema)
    return run


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score), one per document row."""
    from pyspark.sql.pandas.types import to_arrow_type
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(sent, to_arrow_type(kind)),
                           f"id {kind.simpleString()}, lang_pred string, score double")
