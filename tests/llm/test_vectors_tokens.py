"""Vector codes against plain Lloyd, token counts against the libraries."""

import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from riskloom.llm.token_count import Counter, token_count
from riskloom.llm.vector_codes import Tree, _pack, _unpack, digest, edges, vector_codes

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long, _key string"


def plain_lloyd(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label), usable ones of one length, ids apart; by brute force in Python's integers."""
    ids = sorted(range(len(rows)), key=lambda i: rows[i][0])
    x = [[int(np.floor(1024 * float(v))) for v in r[1]] for r in rows]
    w = len(x[0]) // parts
    books = [[x[i][p * w : p * w + w] for i in ids[:entries]] for p in range(parts)]

    def nearest(v, book):
        d = ((np.array(book, dtype=object) - np.array(v, dtype=object)) ** 2).sum(1)
        return min(range(len(book)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in x:
                own.setdefault(nearest(v[p * w : p * w + w], books[p])[0], []).append(v[p * w : p * w + w])
            for k, vs in own.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    code, error, total = {}, {}, {}
    for (i, _, label), v in zip(rows, x, strict=True):
        found = [nearest(v[p * w : p * w + w], books[p]) for p in range(parts)]
        code[i], error[i] = "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found)
        total[label] = total.get(label, 0) + error[i]
    return {i: (code[i], error[i], total[label]) for i, _, label in rows}, digest(np.array(books))


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label, "c", 1, "k") for i, v, label in rows], SCHEMA)


def test_codes_against_plain(spark):
    r = np.random.RandomState(1)
    rows = [(i, (r.randn(8) / 4).astype(np.float32).tolist(), None if i % 5 == 0 else i % 3) for i in range(300)]
    rows += [(300 + i, rows[7][1], 1) for i in range(200)]  # copies
    for n in (1, 3, 60):
        out, books = vector_codes(vectors(spark, rows).repartition(3), entries=n, rounds=3)
        want, sha = plain_lloyd(rows, entries=n, rounds=3)
        assert {x.vec_id: (x.code, x.error, x.label_error) for x in out.collect()} == want
        assert digest(books) == sha


def test_codes_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 0.25, 0, 1], 1), (2, [0.1, 0.1, 0.1, -0.1], None), (2, [0.1, 0.1, 0.1, -0.1], None), (None, [1e30, -1e30, 0, 0], None), (9, [0.5, 0.25, 0, 1], 1)]
    bad = [(3, None, 1), (4, [0, None, 0, 0], 1), (5, [nan, 0, 0, 0], 1), (6, [0, 0, inf, 0], None)]
    odd = [(7, [1.0, 2.0], 1), (8, [], 1)]
    rows = {}
    for x in vector_codes(vectors(spark, good + bad + odd))[0].collect():
        rows.setdefault(x.vec_id, []).append((x.code, x.error))
    assert set(rows) == {1, 2, 7, 8, 9, None} and len(rows[2]) == 2
    assert rows[7] == rows[8] == [(None, None)] and rows[1] == rows[9] == [("00000000", 0)] and all(e == 0 for _, e in rows[None] + rows[2])
    assert vector_codes(vectors(spark, good).limit(0))[0].count() == 0
    assert vector_codes(vectors(spark, bad))[0].count() == 0
    assert [(x.code, x.label_error) for x in vector_codes(vectors(spark, odd))[0].collect()] == [(None, None)] * 2  # two numbers are no four parts


@pytest.mark.parametrize("scale", [30, 2**22])
def test_tree_filters_whole_subtrees(scale):
    r = np.random.RandomState(2)
    centres = r.randint(-10 * scale, 10 * scale, (40, 4))
    points = (centres[r.randint(0, 40, 5000)] + r.randint(-scale // 10, scale // 10, (5000, 4))).astype(np.int64)
    t = Tree.grow(points)
    assert (t.points == points[t.order]).all() and sorted(t.order) == list(range(5000))
    for level in range(t.depth + 1):  # boxes, sums and borders of every node
        e, base = edges(5000, level), (1 << level) - 1
        for k, (a, b) in enumerate(zip(e[:-1], e[1:], strict=True)):
            own = t.points[a:b]
            assert (own.min(0) == t.lo[base + k]).all() and (own.max(0) == t.hi[base + k]).all() and (own.sum(0) == t.sums[base + k]).all()
    book = np.concatenate([centres, centres[:5], points[:30]])  # with equal entries
    found, sums, counts, whole = t.assign(book)
    d = ((t.points[:, None, :] - book[None]) ** 2).sum(2)
    assert (found == d.argmin(1)).all() and whole > 1500
    assert all((sums[k] == t.points[found == k].sum(0)).all() and counts[k] == (found == k).sum() for k in range(len(book)))
    same = Tree.grow(np.repeat(points[:1], 500, axis=0)).assign(book)
    assert same[3] == 500 and same[2].sum() == 500


def test_packed_integers():
    for a in ([[0, 1]], [[-129, 5]], [[1 << 20, -1]], [[1 << 40, 0]]):
        assert (_unpack(_pack(np.array(a)), 2) == np.array(a)).all()


# --- token counts -----------------------------------------------------------------------------------------------

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "one two", "one  two   three    ", "line\nline\n\n  line \n x", "tab\t x \t y", "it's we'll 'tis 12ab ab12 3.14, (x) [y]", "x" * 5000, "é è ü ß 漢字 仮名 交文 かな ", " nbsp   wide　 x \u0085 y \x1c z",
    "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b <|endof text|>", "🙂 🙂🙂 x👩‍👩‍👧 y", "a ▁ b ▁c", "e ́ x", "word, word; word. " * 300, "A B C D", "\x00 \x01 x", "a \r\n b\r c",
]


def _random_texts():
    r = random.Random(5)
    signs = ["a", "B", "7", " ", " ", " ", "\n", "\t", "'s", ".", ",", "é", "漢", "▁", "<|endoftext|>", " ", "🙂", "́", "_", "-"]
    return ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(1500)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_against_library(spark, name):
    path = public_tokenizers.path(name)
    real = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts = TEXTS + _random_texts() + [t or "" for t in real]
    if path.endswith(".json"):
        want = [len(tokenizers.Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in TEXTS]
        want += [len(x.ids) for x in tokenizers.Tokenizer.from_file(path).encode_batch(texts[len(TEXTS) :], add_special_tokens=False)]
    else:
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)
    got = {r.doc_id: r for r in token_count(df, path=path, limit=20).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len(t.encode()) and got[i].over_limit == (want[i] > 20) for i, t in enumerate(texts))


def test_counts_of_awkward_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "a b"), (2, "a b"), (2, "a b"), (3, "word " * 200_000)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count(df).collect()))
    assert got == [(0, 3, 2, False), (1, 0, 0, False), (2, 3, 2, False), (2, 3, 2, False), (3, 1_000_000, 200_001, True)]
    assert token_count(df.limit(0)).count() == 0


def test_long_texts_are_split_and_memory_is_bounded():
    c = Counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "some words, of a text\n" * 1000
    assert len(c.segments(text)) == 4 * 1000 + 1 and "".join(c.segments(text)) == text
    handed, encode = [], c.encode
    c.encode = lambda texts: handed.append(sum(map(len, texts))) or encode(texts)
    c.count([" ".join(f"w{i}x{k}" for i in range(3000)) for k in range(40)])
    assert len(handed) > 2 and max(handed) < (256 << 10) + 100
    c.count(["y" * 5000])
    assert not any(len(s) > 48 for s in c.known)


def test_other_files_are_refused(tmp_path):
    p = tmp_path / "x.tiktoken"
    p.write_text("")
    with pytest.raises(ValueError, match="json or .model"):
        Counter(str(p))
    assert os.path.exists(p) and pa.__version__
