"""SentencePiece encoding and decoding of a merge (BPE) model, by backtracking.

A merge model joins, again and again, the adjacent pair whose joined string is
the best piece (ties: leftmost).  Merges on both sides of a border that no merge
crosses do not see each other, so a token sequence is the model's encoding
exactly if every token merges to itself and every two adjacent tokens merge to
just those two.  That turns the merge queue into a search from left to right:

* an Aho-Corasick automaton gives the longest piece at every position;
* the longest piece that is compatible with the token before it is taken
  (compatibility: merge the two tokens' characters anew and see whether a merge
  crosses the border; the answers are kept);
* where none fits, its shorter prefixes are tried; where those run out, the
  last token is taken back and the position is marked as failed in a bitfield.
  The encoding of a prefix is unique, so a failed position stays failed.

No merge crosses a border between two characters that no piece holds side by
side.  The word starts are such borders in the usual vocabularies (checked on the
vocabulary; otherwise a whole text is one unit), so texts are encoded word by
word and the encodings of frequent words are kept.

Characters outside the vocabulary become their UTF-8 bytes' pieces where the
model has those, else the unknown piece.  Only models with the identity
normaliser and no user-defined pieces are read; others raise ValueError.

Plan: a map over the documents, no shuffle; memory is one document's tokens and
three bounded tables of known words, pairs and borders.

Edge cases: a null or empty text has no ids and decodes to an empty one;
repeated rows are encoded each; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# Fixed values of the model format: the space mark, the kinds of pieces and of
# models, the text shown for an unknown piece.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
UNKNOWN_TEXT = " ⁇ "

#: Entries of a task's tables of known words and pairs; a full table is emptied.
KNOWN_WORDS, KNOWN_PAIRS = 1 << 19, 1 << 18
#: Longer units are not kept.
KNOWN_CHARS = 48
#: Ids of one Arrow batch of results, and characters of its decoded texts.
BATCH_IDS = 1 << 20

ENCODED = "ids array<int>, decoded string"


def _one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    """Every byte that starts no whole character is shown as one replacement."""
    return "�", error.start + 1


codecs.register_error("piece_bytes", _one_each)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message, one level deep."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        width = {0: None, 1: 8, 2: -1, 5: 4}[key & 7]
        if width is None:
            yield key >> 3, number()
            continue
        width = number() if width < 0 else width
        yield key >> 3, message[at:at + width]
        at += width


class Vocabulary:
    """The pieces of a model file: strings, scores, kinds, and the flags of its normaliser."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        kind, normaliser = None, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                kind = dict(_fields(value)).get(3)
            elif field == 3:
                normaliser = dict(_fields(value))
        if kind != MERGES:
            raise ValueError("not a merge (BPE) model")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only the identity normaliser is supported")
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        #: No piece holds a space mark after another character.
        self.word_starts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)


class KnownWords(dict):
    """Unit -> its ids as bytes; a unit that is not known is encoded and, if short, kept."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, unit: str) -> bytes:
        found = self.find(unit)
        if len(unit) <= KNOWN_CHARS:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[unit] = found
        return found


class Encoder:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        self.vocabulary = v = vocabulary
        self.score = {p: v.scores[i] for p, i in v.ids.items()}
        #: Per token the scores of its own merges in their order, each with the
        #: token's last (first) part after it: what a neighbour to the right (left) meets.
        self.as_left: dict[str, list[tuple[float, str]]] = {}
        self.as_right: dict[str, list[tuple[float, str]]] = {}
        # A piece that does not merge to itself is never a token.
        usable = [p for p in v.ids if self._learn(p)]
        self.usable = set(usable)
        #: Characters that some piece holds side by side.
        self.side_by_side = {p[k:k + 2] for p in usable for k in range(len(p) - 1)}
        self.longest = ahocorasick.Automaton()
        for p in usable:
            self.longest.add_word(p, (p, len(p) - 1))
        self.longest.make_automaton()
        self.shorter: dict[str, str | None] = {}
        #: Last token -> longest piece that follows -> the token that fits.
        self.pairs: dict[str, dict[str | None, str]] = defaultdict(dict)
        self.n_pairs = 0
        self.known = KnownWords(self.unit_ids)
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if v.word_starts else "(?s:.+)").findall
        self.shown = [b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN
                      else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()
                      for p, k in zip(v.pieces, v.kinds)]

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The tokens of ``text`` by merging its characters, and the merges made:
        (score, last part, first part after it)."""
        parts, score, made = list(text), self.score, []
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            made.append((best, parts[-1], parts[0]))
        return parts, made

    def _learn(self, token: str) -> bool:
        """Keep the merges of a token; False if it does not merge to itself."""
        parts, made = self.merged(token)
        self.as_left[token] = [(s, last) for s, last, _ in made] + [(-math.inf, token)]
        self.as_right[token] = [(s, first) for s, _, first in made] + [(-math.inf, token)]
        return parts == [token]

    def compatible(self, left: str, right: str) -> bool:
        """No merge crosses the border of two tokens.

        Their characters are merged anew, best score first and leftmost among
        equals: up to the first merge across the border, either token makes
        its own merges in its own order, so only the parts at the border and
        the scores of the next merges are looked at.
        """
        if left not in self.as_left:
            self._learn(left)  # a character outside the vocabulary
        if right not in self.as_right:
            self._learn(right)
        a, b, score = iter(self.as_left[left]), iter(self.as_right[right]), self.score
        last, first = left[-1], right[0]
        (next_a, part_a), (next_b, part_b) = next(a), next(b)
        across = score.get(last + first)
        while True:
            if across is not None and across > next_a and across >= next_b:
                return False
            if next_a == next_b == -math.inf:
                return True
            if next_a >= next_b:
                last, (next_a, part_a) = part_a, next(a)
            else:
                first, (next_b, part_b) = part_b, next(b)
            across = score.get(last + first)

    def fitting(self, last: str, token: str | None) -> str:
        """The longest token that starts like ``token`` (itself included) and is
        compatible with the one before it ("" for none at all)."""
        found = self.pairs[last].get(token)
        if found is None:
            found = token
            while found is not None and last and not self.compatible(last, found):
                found = self.prefix(found)
            if self.n_pairs >= KNOWN_PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
            found = self.pairs[last][token] = found or ""
            self.n_pairs += 1
        return found

    def prefix(self, token: str) -> str | None:
        """The next shorter token that starts like ``token``; its first character is always one."""
        if token not in self.shorter:
            n = len(token) - 1
            while n > 1 and token[:n] not in self.usable:
                n -= 1
            self.shorter[token] = token[:n] if n > 0 else None
        return self.shorter[token]

    def tokens(self, unit: str) -> list[str]:
        """The model's tokens of a unit (characters outside the vocabulary stand alone)."""
        n = len(unit)
        start: list[str] = list(unit)
        for end, (piece, back) in self.longest.iter(unit):  # a later end at one start is a longer piece
            start[end - back] = piece
        failed = None  # made at the first failure
        taken, last, pairs = [], "", self.pairs
        at, token = 0, start[0] if n else None
        while at < n:
            fits = pairs[last].get(token)
            if fits is None:
                fits = self.fitting(last, token)
            if failed is not None:
                while fits and failed[(at + len(fits)) >> 3] >> ((at + len(fits)) & 7) & 1:
                    fits = self.fitting(last, self.prefix(fits))
            if fits:
                taken.append(fits)
                at += len(fits)
                last = fits
                token = start[at] if at < n else None
                continue
            if not last:
                raise ValueError(f"no encoding of {unit[:80]!r}")
            if failed is None:
                failed = bytearray((n >> 3) + 1)
            failed[at >> 3] |= 1 << (at & 7)
            at -= len(taken.pop())
            token = self.prefix(last)
            last = taken[-1] if taken else ""
        return taken

    def part_ids(self, part: str) -> bytes:
        v, out = self.vocabulary, array("i")
        for token in self.tokens(part):
            i = v.ids.get(token)
            if i is not None:
                out.append(i)
            elif v.bytes:
                out.extend(v.bytes[b] for b in token.encode())
            else:
                out.append(v.unknown)
        return out.tobytes()

    def unit_ids(self, unit: str) -> bytes:
        """The ids of a unit, cut once more where no piece holds both neighbours
        (mostly before a punctuation mark), so that a word is searched once."""
        if unit[1:].isalpha():
            return self.part_ids(unit)
        together = self.side_by_side
        cuts = [k + 1 for k in range(len(unit) - 1) if unit[k:k + 2] not in together]
        if not cuts:
            return self.part_ids(unit)
        return b"".join([self.known[unit[a:b]] for a, b in zip([0] + cuts, cuts + [len(unit)])])

    def normalised(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.vocabulary.dummy_prefix else text

    def encode_array(self, text: str) -> np.ndarray:
        """The ids of a text, without begin and end."""
        units = self.units(self.normalised(text))
        return np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces joined to characters, the dummy prefix removed."""
        v, ids = self.vocabulary, list(ids)
        raw = b"".join(map(self.shown.__getitem__, ids))
        if v.dummy_prefix:
            first = next((i for i in ids if v.kinds[i] != CONTROL), None)
            if first is not None and v.kinds[first] == NORMAL and v.pieces[first].startswith(SPACE):
                raw = raw[1:]
        return raw.decode("utf-8", "piece_bytes")


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The encoder of a model; a Python worker builds it once."""
    key = hashlib.sha256(model).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(model))
    return _ENCODERS[key]


def _encode(model, kind: pa.DataType):
    schema = pa.schema([("id", kind), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def packed(ids: pa.Array, found: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
        ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
        values = np.concatenate(found) if found else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [ids.cast(kind), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
             pa.array(texts, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model.value)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            first, held, found, shown = 0, 0, [], []
            for k in range(batch.num_rows):
                encoded = pieces.encode_array(texts[k].as_py() or "")
                found.append(encoded)
                shown.append(pieces.decode(encoded.tolist()))
                held += len(encoded)
                if held >= BATCH_IDS:
                    yield packed(ids.slice(first, k + 1 - first), found, shown)
                    first, held, found, shown = k + 1, 0, [], []
            if found:
                yield packed(ids.slice(first, len(found)), found, shown)
    return run


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Rows (id, ids, decoded), one per document row.

    ``model`` is a file on the driver (under 1 MB); its bytes are sent to the tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["id"].dataType
    return texts.mapInArrow(_encode(sent, to_arrow_type(kind)), f"id {kind.simpleString()}, {ENCODED}")
