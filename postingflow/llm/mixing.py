"""Mixing sources to target weights by hierarchical budgeting, in DataFrame
functions only.

A token budget runs down a tree of groups (domain, language, source).  At each
node it is shared among the children by weight; a child that cannot use its
share (its capacity is its tokens times ``epochs``) leaves the rest to its
siblings in proportion to their weights.  A node's capacity is that of all its
leaves, so what a whole group lacks goes to the group's own siblings: shortages
are made good among siblings before ancestors.  For children in the order of
capacity / weight, the common rate is the largest value of
(budget - capacity of the children before) / (weight of the others), and a
child gets min(capacity, weight * rate), in whole tokens.

A leaf takes whole epochs of its documents, then a prefix of one more epoch in
an order seeded by (seed, epoch, id): the documents that start before the
leaf's remaining budget is used up, the last of them with the tokens that fit
(``n_taken``).  The prefix is found from the token sums
of ``SLICES`` slices of the order, then inside one slice, so no leaf is sorted
whole; rows are picked by comparing their order key with the leaf's last one,
without a shuffle of the texts.

Edge cases: a null group value is the group ``(none)``; groups without a given
weight have ``DEFAULT_WEIGHT``; a null text has no tokens and is taken along
when its place comes; a row without an id is placed by its text; rows that
share a place (repeated ids, equal texts without one) follow each other in the
order they are read, so the budget is met with them too; an empty table, or one
without tokens, gives an empty result; other columns pass through in ``row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import SPACE
from .sizing import written

# Target weights of the production mix: whole numbers, by level and value.
DOMAINS = ("web", "books", "code")
WEIGHTS = (
    {"web": 50, "books": 30, "code": 20},
    {"en": 40, "de": 20, "fr": 20, "es": 20},
    {},
)
DEFAULT_WEIGHT = 10
#: Budget in percent of all tokens, times a leaf's documents may be used, seed.
PERCENT = 60
EPOCHS = 2
SEED = 17
#: Slices of the seeded order: by the first three hex digits of its key.
SLICES = 4096
#: Leaves up to this number are sent to every task, more are joined by shuffle.
MAX_BROADCAST = 200_000
NONE = "(none)"


def _weight(level: int, column: str, weights):
    value = F.lit(None).cast("int")
    for name, w in weights[level].items():
        value = F.when(F.col(column) == name, F.lit(w)).otherwise(value)
    return F.coalesce(value, F.lit(DEFAULT_WEIGHT))


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget`` to children with ``weight``, ``capacity`` and their parent's ``given``."""
    order = Window.partitionBy(*parent, F.lit(0)).orderBy(F.col("capacity") / F.col("weight"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rated = children.withColumn("rate", (F.col("given") - before).cast("double") / rest)
    rate = F.max("rate").over(Window.partitionBy(*parent, F.lit(0)))
    return rated.withColumn("budget", F.floor(F.least(
        F.col("capacity").cast("double"), F.col("weight") * F.greatest(rate, F.lit(0.0)))).cast("long")).drop("rate")


def budgets(leaves: DataFrame, levels: list[str], weights=WEIGHTS, percent: int = PERCENT,
            epochs: int = EPOCHS) -> DataFrame:
    """Leaf rows (levels, tokens, budget) from leaf rows (levels, tokens)."""
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("all"))
    given = total.select(F.floor(F.col("all") * percent / 100).cast("long").alias("given"))
    parent = None
    for k in range(len(levels)):
        keys = levels[:k + 1]
        children = leaves.groupBy(*keys).agg((F.sum("tokens") * epochs).cast("long").alias("capacity"))
        children = children.withColumn("weight", _weight(k, levels[k], weights))
        above = F.broadcast(given) if parent is None else parent
        children = children.join(above) if parent is None else children.join(above, levels[:k])
        shared = share(children, levels[:k], levels[k])
        parent = shared.select(*keys, F.col("budget").alias("given"))
    return leaves.join(parent.withColumnRenamed("given", "budget"), levels)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a leaf table of checked size; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def mix(docs: DataFrame, levels: tuple[str, ...], id: str = "doc_id", text: str = "text",
        weights=WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows (row, level_1.., n_tokens, epoch, n_taken): each document as often as it is taken.

    ``row`` is the input row as a struct; the first copy is epoch 0.  The
    tokens taken add up to the leaf's budget.
    """
    names = [f"level_{k + 1}" for k in range(len(levels))]
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE), ""))
    # A row without an id is placed by its text.
    key = F.coalesce(F.col(id).cast("string"), F.concat(F.lit("null:"), F.xxhash64(F.col(text).cast("string")).cast("string")))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"),
                       words.cast("long").alias("n_tokens"),
                       *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(n) for c, n in zip(levels, names)))
    sized = written(rows.drop("row"), "mix-sizes")
    leaves = written(sized.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    plan = written(
        budgets(leaves, names, weights, percent, epochs)
        .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
        .withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-plan")

    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), "key"))
    slice_ = F.conv(F.substring("place", 1, 3), 16, 10).cast("int")
    # Token sums of the slices of each leaf's order, and the slice where the budget ends.
    placed = sized.join(_small(plan.where("left > 0")), names).withColumn("place", place).withColumn("slice", slice_)
    sums = placed.groupBy(*names, "left", "slice").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = written(
        sums.withColumn("upto", F.sum("n").over(running)).where(F.col("upto") >= F.col("left"))
        .groupBy(*names).agg(F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
        .select(*names, F.col("e.slice").alias("edge"), F.col("e.before").alias("before")), "mix-edges")
    # Inside that slice, the last place whose document starts within the budget.
    inside = placed.join(_small(edge), names).where(F.col("slice") == F.col("edge")) \
        .groupBy(*names, "left", "before", "place").agg(F.sum("n_tokens").alias("n"))
    start = F.col("before") + F.sum("n").over(
        Window.partitionBy(*names).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    last = inside.withColumn("start", start).where(F.col("start") < F.col("left")).groupBy(*names).agg(
        F.max(F.struct("place", (F.col("left") - F.col("start")).alias("fits"))).alias("m")) \
        .select(*names, F.col("m.place").alias("last"), F.col("m.fits").alias("fits"))
    cuts = written(plan.join(last, names, "left").select(*names, "whole", "last", "fits"), "mix-cuts")

    picked = rows.join(_small(cuts), names).withColumn("place", place)
    sure = picked.withColumn("copies", F.col("whole") + F.when(F.col("place") < F.col("last"), 1).otherwise(0)) \
        .where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))) \
        .select("row", *names, "n_tokens", "epoch", F.col("n_tokens").alias("n_taken"))
    # The rows of a leaf's last place, mostly one: each takes what those before it leave.
    edge_rows = written(picked.where(F.col("place") == F.col("last")).select(
        "row", *names, "n_tokens", "fits", F.col("whole").alias("epoch"), F.monotonically_increasing_id().alias("n")), "mix-last")
    part = F.shiftright("n", 33)
    along = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = edge_rows.groupBy(*names, part.alias("part")).agg(F.sum("n_tokens").alias("t")) \
        .withColumn("before", F.coalesce(F.sum("t").over(along), F.lit(0))).drop("t")
    inside_part = Window.partitionBy(*names, "part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("fits") - F.col("before") - F.coalesce(F.sum("n_tokens").over(inside_part), F.lit(0))
    edged = edge_rows.withColumn("part", part).join(parts, [*names, "part"]).withColumn("left", left).where("left > 0") \
        .select("row", *names, "n_tokens", "epoch", F.least("n_tokens", "left").alias("n_taken"))
    return sure.unionByName(edged)


def _sql_weight(level: int, column: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
    return f"CASE {column} {cases} ELSE {DEFAULT_WEIGHT} END" if cases else str(DEFAULT_WEIGHT)


def _sql_share(parent: str, name: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"{part} ORDER BY CAST(capacity AS DOUBLE) / weight, {name}"
    return f"""SELECT *, CAST(floor(least(CAST(capacity AS DOUBLE), weight * greatest(max(rate) OVER ({part}), 0.0))) AS BIGINT) AS budget
  FROM (SELECT *, CAST(given - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM c)"""


#: The registered query in SQL: the order of a leaf's epoch is sorted whole here.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
    list_extract({list(DOMAINS)!r}, 1 + coalesce(CAST(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1), '') AS BIGINT) % {len(DOMAINS)} AS INT), 0)) AS domain,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
l1 AS (WITH c AS (SELECT domain, (sum(tokens) * {EPOCHS})::BIGINT AS capacity, {_sql_weight(0, 'domain')} AS weight,
    (SELECT CAST(floor(sum(tokens) * {PERCENT} / 100) AS BIGINT) FROM leaf) AS given FROM leaf GROUP BY domain)
  {_sql_share('', 'domain')}),
l2 AS (WITH c AS (SELECT domain, lang, (sum(tokens) * {EPOCHS})::BIGINT AS capacity, {_sql_weight(1, 'lang')} AS weight,
    any_value(l1.budget) AS given FROM leaf JOIN l1 USING (domain) GROUP BY domain, lang)
  {_sql_share('domain', 'lang')}),
l3 AS (WITH c AS (SELECT domain, lang, source, (sum(tokens) * {EPOCHS})::BIGINT AS capacity, {DEFAULT_WEIGHT} AS weight,
    any_value(l2.budget) AS given FROM leaf JOIN l2 USING (domain, lang) GROUP BY domain, lang, source)
  {_sql_share('domain, lang', 'source')}),
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
    CASE WHEN tokens > 0 THEN budget % tokens ELSE budget END AS remaining FROM l3 JOIN leaf USING (domain, lang, source)),
placed AS (SELECT d.*, whole, remaining,
    md5('{SEED}:' || whole || ':' || doc_id) AS place FROM d JOIN plan USING (domain, lang, source)),
started AS (SELECT *, CAST(remaining - (sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens) AS BIGINT) AS fits FROM placed),
taken AS (SELECT *, CAST(unnest(range(0, whole + CASE WHEN fits > 0 THEN 1 ELSE 0 END)) AS INT) AS epoch FROM started)
SELECT doc_id, domain, lang, source, n_tokens, epoch,
  CASE WHEN epoch = whole THEN least(n_tokens, fits) ELSE n_tokens END AS n_taken FROM taken
"""
