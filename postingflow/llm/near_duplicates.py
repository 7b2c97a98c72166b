"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document becomes the set of its word shingles and a signature of ``k``
minimum hashes.  Documents with equal sets are one class, represented by its
smallest id.  A class is posted under its (coordinate, value) pairs, rarest
first: two signatures that agree in at least ``t`` coordinates share a pair
among the ``k - t + 1`` rarest of either (the prefix), so only those posting
lists are merged; the other coordinates of a pair met there are not listed,
their agreement is counted on the two signatures.  Pairs with ``t`` or more
agreements are confirmed on the full shingle sets.  ``t`` lies 6.5 standard
deviations under the agreement expected at the similarity threshold.

Lists are merged without making all their pairs.  First every list compares
its members with one hub, the member whose values are the most frequent (the
likely original of a family of copies).  Then every member is compared with
the hub of its family, the component it came closest to.  Two members A and B
of one family share at most min(|A and hub|, |B and hub|) shingles, unless they
share a shingle that the hub lacks; so what is still apart is compared pair by
pair only where that bound allows a link, or where such a shingle is shared.
Members of different families are compared where their sizes, without the
shingles that no other open member has, allow it.

Edge cases: a null text, or one without words, has an empty set and is linked
with nothing; a text of fewer words than a shingle is one shingle; rows with
one id are one document; a row with a null id is a document known by its text,
larger than every id, and a component of such rows only has a null
``component_id``; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .graph import components, partial_components
from .sizing import written

K = 64
_SHINGLE = 0xC2B2AE3D
#: Nodes from here on stand for rows without an id (ids are smaller).
NO_ID = 1 << 62

SIGNATURES = "id long, n long, set_key binary, tokens array<long>"


def agreement(k: int, percent: int, deviations: float = 6.5) -> int:
    """Least number of agreeing coordinates that a pair over the threshold has."""
    j = percent / 100
    return max(1, int(k * j - deviations * (k * j * (1 - j)) ** 0.5))


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted: (hashes, first of each document)."""
    raw = tb.LOWER[raw]
    starts, ends, first = tb.word_spans(raw, off)
    words = tb.word_hashes(raw, starts, ends)
    h, _, doc = tb.windows(words, first, size, _SHINGLE)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = [tb.rolling(words[first[d]:first[d + 1]], int(count[d]), _SHINGLE)[0] for d in short]
        whole = tb.mix64(np.array(whole, np.uint64) + count[short].astype(np.uint64))
        h, doc = np.concatenate((h, whole)), np.concatenate((doc, short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(off)))


def signatures_of(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Tokens (coordinate << 32 | minimum) of every document; all docs must be non-empty."""
    a, b = tb.seeded(k, 7) | np.uint64(1), tb.seeded(k, 11)
    out = np.empty((len(first) - 1, k), np.int64)
    for i in range(k):
        v = (h * a[i] + b[i]) >> np.uint64(32)
        out[:, i] = np.minimum.reduceat(v, first[:-1]).astype(np.int64) | (i << 32)
    return out


def _sign(size: int, k: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()),
                        ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, off, raw in tb.blocks(batch):
                h, first = shingle_sets(raw, off, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                cuts = np.append(first[:-1][full], len(h))
                tokens = signatures_of(h, cuts, k) if len(full) else np.zeros((0, k), np.int64)
                keys = [None] * (b - a)
                for d in full:
                    keys[d] = hashlib.blake2b(h[first[d]:first[d + 1]].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, k, 0)))), pa.int32()),
                        pa.array(tokens.reshape(-1), pa.int64()))], schema=schema)
    return run


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, off, raw in tb.blocks(batch):
                h, first = shingle_sets(raw, off, size)
                signed = (h ^ np.uint64(1 << 63)).view(np.int64)  # sorted as signed numbers too
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a).cast(pa.int64()),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(signed))], schema=schema)
    return run


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    values, off = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(off[:-1], off[1:])]


def _shared(with_rest: bool):
    """(u, v, both, rest): shared shingles of a pair, and those of u that v lacks."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n_u", pa.int64()), ("n_v", pa.int64()),
                        ("both", pa.int64()), ("rest", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, sizes, rest = [], [], []
            for x, y in zip(_arrays(batch.column("set_u")), _arrays(batch.column("set_v"))):
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                same = y[at] == x if len(y) else np.zeros(len(x), bool)
                both.append(int(same.sum()))
                sizes.append((len(x), len(y)))
                rest.append(x[~same] if with_rest else None)
            yield pa.RecordBatch.from_arrays([
                batch.column("u"), batch.column("v"), pa.array([n for n, _ in sizes], pa.int64()),
                pa.array([n for _, n in sizes], pa.int64()), pa.array(both, pa.int64()),
                pa.array(rest, pa.list_(pa.int64()))], schema=schema)
    return run


def node_of(id: str = "doc_id", text: str = "text"):
    """The node of a document row: its id, or a number from its text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.coalesce(F.col(id).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(body), 3))


class _Join:
    """The state of one run: signatures, prefix lists and sets, all written tables."""

    def __init__(self, docs: DataFrame, id: str, text: str, words: int, percent: int, k: int):
        self.percent, self.t = percent, agreement(k, percent)
        texts = docs.select(node_of(id, text).alias("id"), F.col(text).cast("string").alias("text"))
        self.signed = written(texts.mapInArrow(_sign(words, k), SIGNATURES), "signatures")
        self.classes = written(
            self.signed.where("n > 0").groupBy("set_key")
            .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "classes")
        posts = self.classes.select("rep", "n", F.explode("tokens").alias("token"))
        shared = posts.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
        prefix = k - self.t + 1
        listed = (posts.join(shared, "token").groupBy("rep", "n")
                  .agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("common"), F.sum("f").alias("weight")))
        room = F.greatest(F.lit(0), F.lit(prefix) - (F.lit(k) - F.size("common")))
        chosen = listed.select("rep", "n", "weight", F.explode(F.slice("common", 1, room)).alias("c")) \
            .select("rep", "n", "weight", F.col("c.token").alias("token"))
        self.lists = written(chosen, "prefix")
        paired = self.lists.groupBy("token").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
        members = self.lists.join(paired.select("token"), "token", "left_semi").select(F.col("rep").alias("id")).distinct()
        self.sets = written(texts.join(members, "id", "left_semi").mapInArrow(_sets(words), "id long, shingles array<long>"), "sets")

    def compared(self, pairs: DataFrame, with_rest: bool = False) -> DataFrame:
        """Pairs (u, v) with their numbers of shingles, on the full sets."""
        sets = (pairs.join(self.sets.select(F.col("id").alias("u"), F.col("shingles").alias("set_u")), "u")
                .join(self.sets.select(F.col("id").alias("v"), F.col("shingles").alias("set_v")), "v"))
        return sets.select("u", "v", "set_u", "set_v").mapInArrow(
            _shared(with_rest), "u long, v long, n_u long, n_v long, both long, rest array<long>")

    def linked(self, compared: DataFrame) -> DataFrame:
        return compared.where((F.lit(100) * F.col("both") >= F.lit(self.percent) * (F.col("n_u") + F.col("n_v") - F.col("both")))
                              & (F.col("both") > 0)).select("u", "v")

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures agree in enough coordinates."""
        signed = self.classes.select("rep", "tokens")
        return (pairs.join(signed.select(F.col("rep").alias("u"), F.col("tokens").alias("tu")), "u")
                .join(signed.select(F.col("rep").alias("v"), F.col("tokens").alias("tv")), "v")
                .where(F.size(F.array_intersect("tu", "tv")) >= self.t).select("u", "v").distinct())

    def open_lists(self, roots: DataFrame | None) -> DataFrame:
        """List members with their component, of lists that hold several components."""
        rows = self.lists
        if roots is None:
            rows = rows.withColumn("comp", F.col("rep"))
        else:
            rows = rows.join(roots, F.col("rep") == F.col("node"), "left").select(
                "token", "rep", "n", "weight", F.coalesce("root", "rep").alias("comp"))
        mixed = (rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("lo < hi").select("token"))
        return rows.join(mixed, "token", "left_semi")

    def possible(self, both, a, b):
        """``both`` shared shingles link sets of sizes a and b."""
        return F.lit(100 + self.percent) * both >= F.lit(self.percent) * (a + b)

    def hub_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of every list's hub with its other members, where the sizes allow a link."""
        hub = (rows.groupBy("token").agg(F.min(F.struct((-F.col("weight")).alias("o"), "rep", "n")).alias("h"))
               .select("token", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n")))
        met = rows.join(hub, "token").where((F.col("rep") != F.col("hub"))
                                            & self.possible(F.least("n", "hub_n"), F.col("n"), F.col("hub_n")))
        return met.select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")).distinct()

    def family_pairs(self, rows: DataFrame, compared: DataFrame, roots: DataFrame) -> DataFrame:
        """Every open member (u) with the hub (v) of its family: its own
        component if it is linked, else the component of its closest partner."""
        root = roots.select(F.col("node").alias("p"), "root")
        sides = compared.select(F.col("u").alias("rep"), F.col("v").alias("p"), "both").unionByName(
            compared.select(F.col("v").alias("rep"), F.col("u").alias("p"), "both"))
        closest = (sides.groupBy("rep").agg(F.max_by("p", F.struct("both", -F.col("p"))).alias("p"))
                   .join(root, "p", "left").select("rep", F.coalesce("root", "p").alias("near")))
        grown = roots.select("root").distinct().select(F.col("root").alias("comp"), F.lit(True).alias("grown"))
        members = rows.select("rep", "comp", "weight").distinct().join(grown, "comp", "left").join(closest, "rep", "left")
        family = members.select("rep", "comp", "weight", F.when(F.col("grown"), F.col("comp")).otherwise(
            F.coalesce("near", "comp")).alias("family"))
        hubs = (family.where(F.col("family") == F.col("comp")).groupBy("family")
                .agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub")))
        return family.join(hubs, "family").select(F.col("rep").alias("u"), F.col("hub").alias("v"))

    def rest_pairs(self, rows: DataFrame, family: DataFrame) -> DataFrame:
        """Pairs across components that the bounds leave open (see the module text)."""
        ids = rows.select(F.col("rep").alias("id")).distinct()
        alone = (self.sets.join(ids, "id", "left_semi").select("id", F.explode("shingles").alias("s"))
                 .groupBy("s").agg(F.count("*").alias("c"), F.min("id").alias("rep")).where("c = 1")
                 .groupBy("rep").agg(F.count("*").alias("own")))
        hub = family.select(F.col("u").alias("rep"), F.col("v").alias("hub"), F.col("both").alias("with_hub"))
        rows = rows.join(alone, "rep", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))) \
            .join(hub, "rep", "left").where(F.lit(100) * F.col("most") >= F.lit(self.percent) * F.col("n"))
        columns = ["rep", "n", "comp", "most", "hub", "with_hub"]

        def paired(frame, keys):
            x = frame.select(*keys, *(F.col(c).alias(f"x_{c}") for c in columns))
            y = frame.select(*keys, *(F.col(c).alias(f"y_{c}") for c in columns))
            return x, y, (F.col("x_rep") < F.col("y_rep")) & (F.col("x_comp") != F.col("y_comp"))

        def bound(name):
            return self.possible(F.least(f"x_{name}", f"y_{name}"), F.col("x_n"), F.col("y_n"))

        x, y, apart = paired(rows, ["token"])
        x = x.withColumnRenamed("token", "t")
        same = F.coalesce(F.col("x_hub") == F.col("y_hub"), F.lit(False))
        met = x.join(y, (F.col("t") == F.col("token")) & apart & bound("most")
                     & (~same | (bound("with_hub") & (F.col("x_rep") != F.col("x_hub")) & (F.col("y_rep") != F.col("y_hub")))))
        extra = rows.select(*columns).distinct().join(
            family.select(F.col("u").alias("rep"), F.explode("rest").alias("s")), "rep")
        held = extra.groupBy("hub", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        extra = extra.join(held.select("hub", "s"), ["hub", "s"], "left_semi").withColumn("h", F.col("hub"))
        x, y, apart = paired(extra, ["h", "s"])
        x = x.withColumnsRenamed({"h": "h1", "s": "s1"})
        more = x.join(y, (F.col("h1") == F.col("h")) & (F.col("s1") == F.col("s")) & apart & bound("most"))
        pick = [F.col("x_rep").alias("u"), F.col("y_rep").alias("v")]
        return met.select(*pick).unionByName(more.select(*pick)).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3,
                    percent: int = 85, k: int = K) -> DataFrame:
    """Rows (id, n_shingles, component_id, node, component), one per document row.

    Documents are linked when 100 * |A and B| >= percent * |A or B|; a
    component is everything reachable over links, named by its smallest id.
    ``node`` and ``component`` are the same with rows without an id numbered.
    """
    join = _Join(docs, id, text, words, percent, k)
    hubs = written(join.compared(join.agreeing(join.hub_pairs(join.open_lists(None)))).drop("rest"), "hub-pairs")
    links = join.linked(hubs)
    roots = partial_components(links)
    family = written(join.compared(join.family_pairs(join.open_lists(roots), hubs, roots), True), "family-pairs")
    links = links.unionByName(join.linked(family))
    roots = partial_components(links)
    rest = join.rest_pairs(join.open_lists(roots), family)
    found = written(join.linked(join.compared(join.agreeing(rest))), "rest-links")
    roots = components(links.unionByName(found))
    classes = (join.classes.join(roots, F.col("rep") == F.col("node"), "left")
               .select("set_key", F.coalesce("root", "rep").alias("component")))
    joined = join.signed.join(classes, "set_key", "left").select(
        F.col("id").alias("node"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))

    def known(c):
        return F.when(F.col(c) < NO_ID, F.col(c))
    return joined.select(known("node").alias("id"), "n_shingles", known("component").alias("component_id"),
                         "node", "component")
