"""Whitening, near vectors and token alignment against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import alignment, vector_index, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "vec_id long, embedding array<float>, n long, component int, k long, v string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, None, 2, "x") for i, v in vectors], SCHEMA)


def floats(a):
    return [[float(np.float32(x)) for x in row] for row in a]


def odd_rows():
    return [(9001, None), (9002, []), (9003, [1.0, None] + [0.0] * 6), (9004, [float("nan")] * 8), (9005, [float("inf")] + [0.0] * 7), (9006, [1.0] * 5), (None, [0.5] * 8)]


def test_whitening(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(150, 8)) * [3, 1, 1, 0.5, 0.2, 5, 1, 1] + 2
    a[:, 7] = a[:, 6]  # one dimension twice: the rank is 7
    vectors = list(enumerate(floats(a)))
    vectors += [vectors[3], (777, vectors[4][1])]
    rows = whitening.whiten(table(spark, vectors + odd_rows()), keep=32).toPandas()
    kept = [(i, v) for i, v in vectors + odd_rows() if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), 8
    s = [sum(r[j] for r in x) for j in range(d)]
    v = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert set(rows.component) == set(range(1, 8)) and len(rows) == 7 * n and set(rows.n) == {n}
    want = Counter(sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x)
    assert Counter(rows[rows.component == 1].deviation.tolist()) == want
    for k in range(7):
        got = rows[rows.component == k + 1]
        assert got.explained.iloc[0] == pytest.approx(e[k] / np.trace(v), rel=1e-9)
        assert got.whitened.pow(2).mean() == pytest.approx(1, rel=1e-9) and abs(got.whitened.mean()) < 1e-9
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-9
    _, u = np.linalg.eigh(v)
    centred = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    first = centred @ u[:, -1] / np.sqrt(e[0])
    own = rows[rows.component == 1].whitened.to_numpy()
    assert np.allclose(np.sort(own), np.sort(first)) or np.allclose(np.sort(own), np.sort(-first))


def test_whitening_edges(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # nothing differs
    far = whitening.whiten(table(spark, [(1, [1e15, 0.0]), (2, [-1e15, 0.0]), (3, [0.0, 1.0])])).toPandas()
    assert set(far.component) == {1, 2} and far.deviation.isna().any() and far.identity_error.iloc[0] < 1e-4


def test_whitening_huge_entries(spark):
    """Entries beyond the longs stand for their bound: no crash, and the same exactness."""
    rows = whitening.whiten(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0]), (4, [1e30, -4.0])])).toPandas()
    assert set(rows.component) == {1, 2} and rows.identity_error.iloc[0] < 1e-4 and rows[rows.component == 1].explained.iloc[0] > 0.99


def test_primes():
    moduli = whitening.primes(10**30)
    assert np.prod([int(p) for p in moduli[:-1]], dtype=object) > 10**30 and len(set(moduli)) == len(moduli)
    values = np.array([0, -5, 123456789012345678901234567, -(10**29)], object)
    residues = np.array([[int(v % p) for v in values] for p in moduli[:-1]])
    assert (whitening.chinese(residues, moduli[:-1]) == values).all()
    assert whitening.rank(np.array([[2, 4], [1, 2]], object)) == 1


def brute_links(vectors, threshold=0.95):
    good = [(i, np.array(v, np.float64)) for i, v in vectors if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = Counter(), {i: i for i, _ in vectors if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    out = Counter((i, links[a], top(i), top(i) == i) for a, (i, _) in enumerate(good))
    ids = {id(v) for _, v in good}
    return out, good, ids


def near_table(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(400, 8))
    near = [b + rng.normal(size=8) * s for b, s in zip(base[:120], rng.uniform(0, 0.3, 120))]
    chain = np.cumsum(rng.normal(size=(40, 8)) * 0.12, axis=0) + 1  # links that make long paths
    hot = [base[0]] * 60 + [base[0] + rng.normal(size=8) * 0.05 for _ in range(50)]
    vectors = list(enumerate(floats([*base, *near, *chain, *hot])))
    rng.shuffle(vectors)
    return [(int(i), v) for i, v in vectors] + [(7000, [0.0] * 8), (7001, [1e-30] * 8), (7002, [1e30] * 8), (7003, [1.0] * 8), (7004, [-0.0] + [1.0] * 7), (7005, [0.0] + [1.0] * 7), (3, vectors[0][1])]


@pytest.mark.parametrize("per_list, tile", [(64, 4096), (16, 40)])
def test_near_vectors(spark, monkeypatch, per_list, tile):
    monkeypatch.setattr(vector_index, "TILE", tile)
    vectors = near_table(1)
    got = vector_index.near_vectors(table(spark, vectors + odd_rows()), per_list=per_list, margin=6.0).collect()
    want, good, _ = brute_links(vectors + odd_rows())
    seen = Counter(tuple(r) for r in got)
    odd = [(i, v) for i, v in vectors + odd_rows() if not any(v is g for _, g in good)]
    assert len(got) == len(vectors) + 7
    alone = [(9001, 0, 9001, True), (9006, 0, 9006, True), (None, 0, None, True), (7000, 0, 7000, True)]
    assert all(seen[a] == 1 for a in alone) and odd
    assert not want - seen  # at a wide margin nothing is lost


def test_near_vectors_recall(spark):
    vectors = near_table(2)
    got = vector_index.near_vectors(table(spark, vectors), per_list=8).collect()
    want, _, _ = brute_links(vectors)
    assert sum(r.n_links for r in got) >= 0.95 * sum(n * c for (_, n, _, _), c in want.items())
    assert vector_index.near_vectors(table(spark, [])).count() == 0
    assert [tuple(r) for r in vector_index.near_vectors(table(spark, [(5, [1.0, 0.0]), (4, [1.0, 0.0]), (6, None)])).orderBy("vec_id").collect()] == [(4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)]


def brute_alignment(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    rows, total = [], Counter()
    for i, t in docs:
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        bytes_a, bytes_b = [bytes(byte_of[c] for c in tok.id_to_token(x)) for x in a], [piece(x) for x in b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            rows.append((i, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(a[ends_a.index(e)], b[ends_b.index(e)]) for e in sorted(set(ends_a) & set(ends_b))]
        groups, lo, hi = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append((a[lo:x], b[hi:y]))
            lo, hi = x, y
        total.update(links)
        rows.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = Counter()
    for i, a, b, groups, links in rows:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[(i, len(a), len(b), len(groups), len(links), sum(total[x] == most[x[1]] for x in links), sum(total[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if a else "")] += 1
    return out


def text_table(seed=3):
    rng = random.Random(seed)
    words = ["the", "straße", "日本語", "naïve", "x1y2", "Ünïcode", "don't", "😀", "a|b", "<|endoftext|>", "</s>", "\n\n", "\t", "  ", "hello", "world", "tokenization", "<0x41>"]
    docs = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(80)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " "), (103, "  "), (104, "a "), (105, " a"), (106, "▁x y"), (107, "x▁ y"), (108, "\n"), (109, "　 a  b"), (110, "word " * 4000), (111, "x" * 6000), (112, "日" * 3000), docs[5], docs[5]]
    return docs


@pytest.mark.parametrize("pack", [16 << 20, 500])
def test_link_counts(spark, monkeypatch, pack):
    monkeypatch.setattr(alignment, "PACK", pack)
    docs = text_table()
    frame = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in docs], "doc_id long, text string, pack long, at int, key string").repartition(3)
    got = alignment.link_counts(frame, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter(tuple(r)[:8] for r in got.collect()) == brute_alignment(docs)
    assert alignment.link_counts(frame.limit(0), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_links_of_each_kind():
    found = alignment.Alignment(np.array([2, 5, 6]), np.array([3, 4, 5, 6]))
    assert [x.tolist() for x in found.links("overlaps")] == [[0, 1, 1, 1, 2], [0, 0, 1, 2, 3], [0, 0, 0, 0, 1]]
    assert [x.tolist() for x in found.links("ends")] == [[1, 2], [2, 3], [0, 1]]
    assert [x.tolist() for x in found.links("groups")] == [[0, 0, 0, 1, 1, 1, 2], [0, 1, 2, 0, 1, 2, 3], [0, 0, 0, 0, 0, 0, 1]]


def test_align(spark):
    docs = [(1, "tokenization of naïve text"), (2, None), (3, "▁"), (4, "")]
    rows = {r.doc_id: r for r in alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert rows[1].groups[-1].stop == len((" " + docs[0][1]).encode()) and rows[1].groups[-1].a_stop == len(rows[1].a_ids) and rows[1].overlaps[-1].b == len(rows[1].b_ids) - 1
    assert all(not rows[i].groups and not rows[i].a_ids for i in (2, 3, 4))
