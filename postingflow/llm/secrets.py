"""Secret scan: known credential forms plus a token-efficiency test.

Ordinary text costs few tokens: a byte-pair vocabulary holds its words and
syllables.  A random string costs a token every two characters or less.  So
every long run of credential characters is encoded with a tiktoken
vocabulary, and a run with a low ratio of characters to tokens is reported
(kind ``random``), unless it is a known digest (hexadecimal of a digest's
length), a UUID, a number, a row of equal or successive characters, or an
identifier whose parts the vocabulary holds as words.  The base kinds
``assign``, ``access`` and ``hex`` are patterns and are always reported.

The scan is a map over the documents: no shuffle, memory of one batch.

Edge cases: a null text is an empty one and has no spans; repeated rows are
scanned each; an empty table gives an empty result; columns other than the id
and the text are not read.  Positions are code points, end exclusive.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The base kinds in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII)
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

# The split pattern of the vocabulary, digest lengths in hex
# digits (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), UUID layout.
SPLIT = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Characters per token under which a run counts as random.
RATIO = 2.2
#: Letters per token from which the parts of a run count as words.
WORD_RATIO = 2.5
#: Breaks in a row of equal or successive characters (the base64 alphabet has four).
JUMPS = 4

SPANS = "array<struct<kind:string,start:int,end:int>>"


def encoder(ranks: bytes):
    """A tiktoken encoding from the lines of a rank file."""
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})


def known(run: str) -> bool:
    """Digests, UUIDs, numbers, rows of equal or successive characters: not random secrets."""
    core = run.strip("+/_=-")
    if UUID.fullmatch(core) or re.fullmatch(r"[0-9+/_=-]*", core):
        return True
    if len(core) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
        return True
    return sum(ord(b) - ord(a) not in (0, 1) for a, b in zip(core, core[1:])) <= JUMPS


def identifier(run: str, encoding) -> bool:
    """Words joined by case, dashes, slashes or underscores, with few digits.

    The parts are words if the vocabulary holds them in large pieces once case
    is set aside; letters alone are no evidence, as a random key has them too.
    """
    parts = PARTS.findall(run)
    words = [p.lower() for p in parts if p.isalpha()]
    letters = sum(map(len, words))
    return letters >= 0.8 * sum(map(len, parts)) and \
        letters >= WORD_RATIO * sum(len(encoding.encode_ordinary(w)) for w in words)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    for run in RUN.finditer(text):  # both kinds lie inside such a run
        for kind, pattern, least in ((1, ACCESS, ACCESS_CHARS), (2, HEX, HEX_CHARS)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text, *run.span())
                      if m.end() - m.start() >= least]
    return found


def scan_text(text: str, encoding, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """All spans, ordered by start and kind."""
    found = base_spans(text)
    for m in RUN.finditer(text):
        inside = any(s < m.end() and m.start() < e for s, _, e in found)
        if not inside and not known(m[0]) and len(m[0]) < ratio * len(encoding.encode_ordinary(m[0])) \
                and not identifier(m[0], encoding):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _scan(ranks, ratio: float, kind: pa.DataType):
    schema = pa.schema([("id", kind), ("text", pa.string()), ("spans", pa.list_(pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value)
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e}
                      for s, k, e in scan_text(t.as_py() or "", encoding, ratio)]
                     for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(kind), batch.column("text").cast(pa.string()),
                 pa.array(spans, schema.field("spans").type)], schema=schema)
    return run


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text",
                 vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """Rows (id, text, spans), one per document row.

    ``vocabulary`` is a tiktoken rank file on the driver (under 1 MB); its
    bytes are what is sent to the tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    spark: SparkSession = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["id"].dataType
    return texts.mapInArrow(_scan(ranks, ratio, to_arrow_type(kind)),
                            f"id {kind.simpleString()}, text string, spans {SPANS}")


def redacted(text, spans, mark: str = "[SECRET]"):
    """The text with every maximal run of spans replaced by ``mark`` (Columns)."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    joined = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        start, lambda acc, s: F.when(s["start"] + 1 >= acc["at"], F.struct(
            (s["end"] + 1).alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"], s["start"] + 1 - acc["at"]),
                     F.lit(mark)).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
