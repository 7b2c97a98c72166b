"""SentencePiece encoding against the library, periodic runs against plain Python."""

import random

import brute
import fixtures
import numpy as np
import pytest

from postingflow.llm import periodic_runs, pieces, queries
from postingflow.llm import textblocks as tb

SF = "/root/testdata/sf0.001"


def key(values):
    return sorted(values, key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    sample = [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return fixtures.awkward() + sample


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def encoder():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Encoder(pieces.Vocabulary(f.read()))


def test_encoding_query(spark, tmp_path, rows, library):
    fixtures.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_sentencepiece"](spark, str(tmp_path)).collect()
    want = []
    for i, text in rows:
        ids = library.encode(text or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    assert key(map(tuple, got)) == key(want)


def texts(encoder, kind, rng):
    vocabulary = list(encoder.vocabulary.ids)
    return "".join({
        "letters": lambda: rng.choices("ab th e\n▁ ", k=rng.randrange(30)),
        "pieces": lambda: rng.choices(vocabulary, k=rng.randrange(12)),
        "codes": lambda: [chr(rng.choice([rng.randrange(0, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x4E00, 0x5000),
                                          rng.randrange(0x1F300, 0x1F600), 0x20])) for _ in range(rng.randrange(20))],
        "spaces": lambda: [" " * rng.randrange(80), "x" * rng.randrange(50), " " * rng.randrange(70), "\n" * rng.randrange(9)],
        "one word": lambda: rng.choices("aeinrst", k=rng.randrange(80))}[kind]())


@pytest.mark.parametrize("kind", ["letters", "pieces", "codes", "spaces", "one word"])
def test_encoding_of_random_texts(encoder, library, kind):
    rng = random.Random(kind)
    for _ in range(2000):
        text = texts(encoder, kind, rng)
        ids = encoder.encode(text)
        assert ids == library.encode(text), text
        assert encoder.decode(ids) == library.decode(ids), text


@pytest.mark.parametrize("text", [" " * 50000, "a" * 50000, "ab " * 20000, "é€" * 20000, "\n\t" * 20000],
                         ids=["spaces", "letters", "words", "bytes", "controls"])
def test_long_texts(encoder, library, text):
    assert encoder.encode(text) == library.encode(text)


def test_decoding_of_any_ids(encoder, library):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 28705]) for _ in range(rng.randrange(8))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_small_tables_change_nothing(encoder, library, monkeypatch, rows):
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 40)
    monkeypatch.setattr(pieces, "KNOWN_PAIRS", 10)
    monkeypatch.setattr(pieces, "KNOWN_CHARS", 5)
    small = pieces.Encoder(encoder.vocabulary)
    for _, text in rows[:120]:
        assert small.encode(text or "") == library.encode(text or "")
    assert len(small.known) <= 40 and sum(map(len, small.pairs.values())) <= 10


def test_backtracking_is_needed_and_marks_positions(encoder):
    """Some words' longest first piece is not their first token."""
    rng, other = random.Random(4), 0
    for _ in range(4000):
        word = "".join(rng.choices("aeinrstho", k=9))
        taken = encoder.tokens(word)
        assert "".join(taken) == word
        longest = next(word[:n] for n in range(9, 0, -1) if word[:n] in encoder.usable)
        other += taken[0] != longest
    assert other > 50


def test_models_that_are_not_merge_models(encoder):
    with open(pieces.MODEL, "rb") as f:
        model = f.read()
    with pytest.raises(ValueError):
        pieces.Vocabulary(b"")
    assert pieces.Vocabulary(model).dummy_prefix


def test_runs_query(spark, tmp_path, rows):
    loops = [(7000 + k, " ".join(fixtures.words(3 * k, k, 3 + k))) for k in range(120)]
    loops += [(8000, "a " * 500), (8001, "a b " * 300 + "c"), (8002, "x " * 5), (8003, "x " * 6), (8004, "a b a b a b a b"),
              (8005, "a b a b a b a"), (8006, ("a a a a a a b " * 5)), (8007, "p q r s " * 4 + "t " + "t u " * 4)]
    docs = rows + loops
    fixtures.frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    want = brute.runs(docs)
    assert sum(w[1] for w in want) > 60
    assert key(map(tuple, got)) == key(want)


def block(docs):
    """The arrays of a block of documents given as lists of numbers."""
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    doc = tb.document_of(first)
    flat = np.array([x for d in docs for x in d], np.uint64)
    words = tb.mix64(flat + np.uint64(10 ** 9)) ^ tb.mix64(doc.astype(np.uint64) + np.uint64(1))
    return words, first[doc + 1], first[doc]


def drawn(rng):
    n, letters = rng.randrange(150), rng.choice([1, 2, 3, 5, 50])
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("seed", range(40))
def test_suffixes_and_runs_of_a_block(seed, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", random.Random(seed).choice([1, 7, 1 << 20]))
    rng = random.Random(seed)
    docs = [drawn(rng) for _ in range(rng.randrange(1, 12))]
    words, end, begin = block(docs)
    order, place, lcp = periodic_runs.suffix_array(words, end)
    suffix = [tuple(words[i:end[i]].tolist()) for i in order]
    assert len(set(order.tolist())) == len(words) and (place[order] == np.arange(len(words))).all()
    for k in range(1, len(order)):
        n = next((j for j, (x, y) in enumerate(zip(suffix[k - 1], suffix[k])) if x != y), min(len(suffix[k - 1]), len(suffix[k])))
        assert lcp[k] == n
    low, length, q = periodic_runs.runs_of(words, end, begin)
    got = [(int(a), int(b), int(c)) for a, b, c in zip(low, length, q)]
    first = np.cumsum([0] + [len(d) for d in docs])
    assert got == [(first[k] + s, n, p) for k, d in enumerate(docs) for s, n, p in brute.word_runs(d)]


def test_work_stays_near_linear():
    """Suffixes that ask: n log n at most, also where every word is equal."""
    for w in ([1] * 4096, [1, 2] * 2048, list(range(64)) * 64, [k & -k for k in range(1, 4097)]):
        words, end, _ = block([w])
        lcp = periodic_runs.suffix_array(words, end)[2]
        asked = sum(int((b - a).sum()) for *_, a, b in periodic_runs.children(lcp))
        assert asked <= 4096 * 12


def test_empty_tables(spark):
    empty = fixtures.frame(spark, [])
    assert pieces.encode(empty).collect() == []
    assert periodic_runs.periodic_runs(empty).collect() == []
