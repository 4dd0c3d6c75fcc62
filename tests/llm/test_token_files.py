"""Token files: an exact round trip against the tokenizer itself, and the coding alone."""
import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from gatherlens.llm import token_files as T
from gatherlens.llm import vocab
from tests.llm.brute import EDGES, near_copies

ODD = ["<|startoftext|> in <|endoftext|>text", "a\x1cb \x85 c d", "é ́x ΣΑΣ Σ", "   \t\r\n x", "İI ıi ß", "'s it's I'LL",
       "123 4५6", "ﬁ ① ²", "no blank " + "x" * 3000]


def brute(rows):
    t = Tokenizer.from_file(vocab.public(T.VOCABULARY))
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def result(df, **options):
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in T.round_trip(df, **options).collect()]
    return sorted(got, key=lambda r: r[1])


def test_equals_the_tokenizer(spark, documents, monkeypatch):
    texts = EDGES + ODD + near_copies(3)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    monkeypatch.setattr(T, "RANGE_BYTES", 20000)
    monkeypatch.setattr(T, "BLOCK_IDS", 64)
    monkeypatch.setattr(T, "ROLL_IDS", 512)
    want = brute(list(zip(ids, texts)))
    assert result(documents(texts, ids).repartition(3)) == want
    assert [r[1] for r in want] == sorted(r[1] for r in want)


def test_pieces_that_are_forgotten():
    made = []

    def make(pieces):
        made.extend(pieces)
        return [vocab.packed([len(p)] * len(p)) for p in pieces]
    known = T.Known(make, most=4)
    rng = random.Random(2)
    for _ in range(40):
        lists = [["x" * rng.randint(0, 9) for _ in range(rng.randint(0, 4))] for _ in range(3)]
        ids, ends = known.of(pa.array([[p.encode() for p in ps] for ps in lists], pa.list_(pa.binary())))
        want = [[len(p) for p in ps for _ in p] for ps in lists]
        assert ids.tolist() == sum(want, [])
        assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
        assert len(known.pieces) <= 4
    assert len(made) > 10 and known.of(pa.array([], pa.list_(pa.binary())))[0].tolist() == []


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "b"), (7, "x y"), (7, "x y"), (-1, None), (None, "b")], "doc_id long, text string")
    assert result(df) == brute([tuple(r) for r in df.collect()])
    assert result(df.limit(0)) == []
    assert T.round_trip(df.where("doc_id = -1"), end=None).collect()[0]["ids"] == b""


def test_other_names(spark):
    df = spark.createDataFrame([(3, "one", 5, "z")], "id long, `my text` string, part long, row string")
    assert [r[:2] for r in result(df, id_col="id", text="my text")] == [(3, 0)]


def test_coding_of_all_lengths():
    rng = np.random.RandomState(4)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = (rng.randint(0, 1 << 32, n, dtype=np.uint64) >> rng.randint(0, 33, n).astype(np.uint64)).astype(np.uint32)
        control, data = T.code(ranks)
        assert len(control) == -(-n // 4)
        assert (T.decode(control, data, n) == ranks).all()
    edge = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    assert len(T.code(edge)[1]) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4
    assert (T.decode(*T.code(edge), 8) == edge).all()


def test_frequent_ids_take_one_byte():
    ranks = np.array([0] * 100, np.uint32)
    control, data = T.code(ranks)
    assert len(data) == 100 and len(control) == 25
