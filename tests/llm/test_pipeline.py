"""The whole pipeline against a version of its five stages in plain Python, tokens included."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import quality

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sound(t):
    t = t or ""
    w, at = words(t), defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeated = len({j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 8)})
    if len(w) < 20 or 100 * repeated > 30 * len(w):
        return False
    lines = [x for x in t.split("\n") if words(x)]
    stop = sum(x.rstrip(".,;:!?").lower() in quality.STOP_WORDS for x in w)
    chars, signs = sum(map(len, w)) / len(w), sum(c in "#*$%&|<>" for c in t) / len(w)
    return repeated / len(w) <= 0.3 and 1.5 <= chars <= 20 and signs <= 0.3 and (len(lines) - len(set(lines))) / len(lines) <= 0.5 and (len(w) < 50 or stop / len(w) >= 0.02)


def shingles(t):
    w = words(az(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    docs = [(i, t) for i, t in docs if sound(t)]
    last = {}
    for i, t in docs:
        last[az(t)] = max(last.get(az(t), i), i)
    docs = [(i, t) for i, t in docs if last[az(t)] == i]
    sets, part = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(i):
        return i if part[i] == i else top(part[i])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                part[b] = a
    docs = [(i, t) for i, t in docs if top(i) == i]
    seen = Counter(tuple(w[k : k + 35]) for _, t in docs for w in [words(t)] for k in range(len(w) - 34))
    out = []
    for i, t in docs:
        w = words(t)
        gone = {k for a in range(len(w) - 34) if seen[tuple(w[a : a + 35])] > 1 for k in range(a, a + 35)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
        if text:
            out.append((i, text))
    return out


def corpus():
    rng = random.Random(11)
    plain = [f"word{i}" for i in range(400)] + ["the", "of", "and", "Größe", "日本"] * 20
    text = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    docs = [(i, text(rng.randrange(15, 140))) for i in range(60)]
    passage = text(60)
    docs += [(100 + i, f"{text(40)} {passage} {text(30)}") for i in range(4)]
    for i in range(6):  # near copies, in chains
        w = docs[10 + i][1].split() if i < 3 else docs[-1][1].split()
        w[len(w) // 2] = f"edit{i}"
        docs.append((200 + i, " ".join(w)))
    docs += [(300, docs[5][1]), (301, docs[5][1].upper().lower()), (302, None), (303, ""), (304, passage), (305, "short"), (306, "# | " * 40), (307, "\n".join(["the same line of text again"] * 12)), (308, "of " + text(3000)), (309, f"{passage} {passage}")]
    return docs


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = corpus()
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").toPandas()
    tok, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    left = brute(docs)
    assert 20 < len(left) < len(docs)
    for i, t in left:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids) + 1, 1024)])):
            want[(i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter(zip(rows.doc_id, rows.piece, rows.start, rows.length, rows.ids_crc32)) == want
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 1024 and (s.offset.to_numpy() == np.append(0, np.cumsum(s.length)[:-1])).all()


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, None)]])
def test_pipeline_without_texts(spark, tmp_path, rows):
    """An empty table, or one without a text to keep, gives no rows; a column more than the five goes."""
    frame = spark.createDataFrame([(i, t, None, None, None, 7) for i, t in rows], SCHEMA + ", word long")
    frame.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_long_text(spark):
    """One text of some hundred thousand words goes through every stage."""
    rng = random.Random(3)
    long_text = " ".join(rng.choice(["the", "of"]) + f"{rng.randrange(10**6)} the" for _ in range(60_000))
    docs = spark.createDataFrame([(1, long_text, "en", "s", 1), (2, "the cat and the dog went to the sea and the sky of a day in May with us all there", "en", "s", 1)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {1, 2}
