"""Empty tables, clashing names, ties, long texts, hot groups and mixed parts, operator by operator."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import az, public_tokenizers, removed, roots
from tidemark.llm import bpe_pieces, chat_format, exact_dedup, jaccard_join, license_scan, line_dedup, packing, quality, recompression, suffix_groups

CLASHING = "doc_id long, text string, h string, name string, n long, id long, rep long, part long, words long, line string, band long, n_words long, h2 long, kept boolean, component long, label string"


def clashing(spark, docs):
    return spark.createDataFrame([(i, t, None, "x", 1, 2, None, 5, 6, "l", 7, 8, 9, None, 1, "mit") for i, t in docs], CLASHING)


def pieces_path():
    return public_tokenizers.path("piece_bpe_32k.model")


def bytes_path():
    return public_tokenizers.path("byte_bpe_50k.json")


OPERATORS = {
    "recompression": lambda d: recompression.drop_repeats(d),
    "suffix groups": lambda d: suffix_groups.drop_repeated_bytes(d),
    "exact groups": lambda d: exact_dedup.exact_groups(d),
    "exact copies": lambda d: exact_dedup.drop_exact_copies(d),
    "license scan": lambda d: license_scan.license_scan(d),
    "quality": lambda d: quality.quality(d),
    "pieces": lambda d: bpe_pieces.digests(d, pieces_path()),
    "packing": lambda d: packing.pack_documents(d, bytes_path()),
    "line counts": lambda d: line_dedup.line_counts(d),
    "drop lines": lambda d: line_dedup.drop_lines(d),
    "jaccard": lambda d: jaccard_join.near_copies(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](clashing(spark, [])).count() == 0


@pytest.mark.parametrize("name", list(OPERATORS))
def test_nulls_only(spark, name):
    """Null and empty texts, a null id and a row given twice, with columns that operators use themselves."""
    docs = [(1, None), (2, ""), (None, None), (2, ""), (3, " \n\t "), (4, "one two three four five six\none two three four five six")]
    rows = OPERATORS[name](clashing(spark, docs)).collect()
    assert len(rows) == (2 if name == "exact copies" else 6) if name != "exact copies" else len(rows) >= 2


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, start long, at long, body string")
    assert chat_format.format_chats(df).count() == 0


def test_chat_parts(spark):
    """Types that would forge a control string, attachments of each kind, null parts, and a long text."""
    rows = [(1, 0, "user"), (1, 1, "assistant")]
    long = "<|end|>" * 20_000
    given = F.when(
        F.col("turn") == 0,
        F.expr("array(named_struct('type','text','text','a <|end|> b','ref',CAST(NULL AS STRING)), named_struct('type','image','text',CAST(NULL AS STRING),'ref','i.png'), named_struct('type','end','text',CAST(NULL AS STRING),'ref','e'), named_struct('type','audio','text',CAST(NULL AS STRING),'ref','s.wav'), named_struct('type','document','text',CAST(NULL AS STRING),'ref','d.pdf'), CAST(NULL AS struct<type:string,text:string,ref:string>))"),
    ).otherwise(F.expr(f"array(named_struct('type','text','text',repeat('<|end|>', 20000),'ref',CAST(NULL AS STRING)))"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string")
    r = chat_format.format_chats(df, parts=given).withColumn("back", chat_format.read_back(F.col("formatted"))).first()
    assert [(x.role, x.text) for x in r.back] == [("user", "a <|end|> b<|image|><|other|><|audio|><|document|>"), ("assistant", long)]
    assert [(a.type, a.ref) for a in r.attachments] == [("image", "i.png"), ("end", "e"), ("audio", "s.wav"), ("document", "d.pdf")]
    assert r.expanded_tokens == sum(chat_format.EXPANDED.values())
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == [re.sub(r"<\|", r"<\\|", long)]


def test_license_labels(spark):
    """Labels and scores against votes counted by hand; a tie of two templates, a notice given twice, an edited one."""
    mit, bsd = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["bsd"]
    edited = mit.split()
    edited[20] = "changed"
    docs = [(1, f"{mit} . {bsd}"), (2, f"{mit} and again {mit}"), (3, " ".join(edited)), (4, " ".join(mit.split()[:9])), (5, "x " * 30_000 + mit), (5, mit), (6, " ".join(reversed(mit.split())))]
    got = {}
    for r in license_scan.license_scan(clashing(spark, docs)).collect():
        got.setdefault(r.doc_id, []).append((r.labels, round(r.score, 4)))
    n = len(mit.split())
    assert got[1] == [("bsd,mit", 1.0)] and got[2] == [("mit", 1.0)]
    covered = set()
    for i in range(n - 4):
        if 20 not in range(i, i + 5):
            covered |= set(range(i, i + 5))
    assert got[3] == [("mit", round(len(covered) / n, 4))]
    assert got[4] == [("", 0.0)] and got[6] == [("", 0.0)]
    assert [x[0] for x in got[5]] == ["mit", "mit"]


def test_packing_full_pieces(spark):
    """Long texts: their full pieces are sequences of their own; everything stays gapless and unique."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([3, 900, 5000])))) for i in range(40)]
    rows = packing.pack_documents(clashing(spark, docs), bytes_path()).toPandas()
    assert (rows.length == 1024).sum() > 20
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024
    assert rows.groupby("doc_id").length.sum().min() > 1
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) + 2


def links_of(docs):
    sets = {}
    for i, t in docs:
        w = az(t).encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(links)
    return {i: root.get(i, i) for i in ids}, len(links)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_hot_group(spark, seed):
    """Copies of one text around the threshold, some of them cut, unlike texts that share a passage, and exact copies of two."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60 if seed == 1 else 5000)]
    base, passage = [rng.choice(words) for _ in range(150)], [f"p{i}" for i in range(60)]
    docs = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append(" ".join(w[: rng.choice([150, 150, 150, rng.randrange(105, 150)])]))
    docs += [" ".join(passage + [rng.choice(words) for _ in range(rng.randrange(10, 60))]) for _ in range(80)]
    docs += docs[:20]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    want, n = links_of(docs)
    assert n > 500
    got = {r.doc_id: r.component_id for r in jaccard_join.near_copies(clashing(spark, docs)).collect()}
    assert got == want


def test_long_texts(spark):
    """Very long texts and lines, one of them without spaces, go through the operators that compare documents."""
    rng = random.Random(12)
    long = " ".join(f"u{rng.randrange(10**9)}" for _ in range(6_000))
    docs = [(1, long), (2, long + " tail"), (3, "z" * 30_000), (4, "z" * 30_000 + "y")]
    want, _ = links_of(docs)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_copies(clashing(spark, docs)).collect()} == want
    gone = {(r.doc_id, r["at"]) for r in line_dedup.repeated_lines(clashing(spark, docs)).collect()}
    assert gone == {(2, 0)}  # one more kind of shingle halves the similarity of the last two
    pieces = [tuple((t or "").encode().split()) for _, t in docs]
    told = {r.doc_id: r.n_removed for r in recompression.drop_repeats(clashing(spark, docs)).collect()}
    assert told == {i: sum(g) for (i, _), g in zip(docs, removed(pieces, 35))}


def test_lines_common_head(spark):
    """Pairs of near lines among very many that share a common head: recall against what was planted, by the operator's own shingles."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9)))
    found = Counter()
    for head, own in ((20, 8), (24, 7)):
        common = " ".join(word() for _ in range(head))
        docs, near = [], 0
        q = line_dedup.SHINGLE
        sets = lambda t: {t[k : k + q] for k in range(len(t) - q + 1)}
        for i in range(300):
            rest = [word() for _ in range(own)]
            edit = list(rest)
            edit[rng.randrange(own)] = word()
            a, b = f"{common} {' '.join(rest)}", f"{common} {' '.join(edit)}"
            near += 100 * len(sets(a) & sets(b)) >= 75 * len(sets(a) | sets(b))
            docs += [(2 * i, a), (2 * i + 1, b)]
        gone = {r.doc_id for r in line_dedup.repeated_lines(clashing(spark, docs)).collect()}
        found[head] = len(gone) / near
    assert min(found.values()) >= 0.95, found


def test_quality_rules_columns(spark):
    """Ties of thresholds and repeated rows keep one verdict each."""
    text = "the cat sat on the mat and looked at the dog of the house in the morning with a smile on the face"
    rows = quality.quality(clashing(spark, [(1, text), (1, text)])).collect()
    assert len(rows) == 2 and len({(r.kept, r.base_failed) for r in rows}) == 1


def test_jaccard_further_hubs(spark, monkeypatch):
    """Copies of a text that isn't there, cut at many lengths: hub after hub links them, and few pairs between parts are left to compare."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(150)]
    docs = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(w[: rng.randrange(100, 150)])))
    compared = []
    real = jaccard_join._verified

    def counted(pairs, *more):
        compared.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_copies(clashing(spark, docs)).collect()}
    assert got == links_of(docs)[0]
    assert compared[-1] < 15 * len(docs)
