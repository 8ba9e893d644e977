"""Corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_pieces, chat_format, exact_dedup, jaccard_join, license_scan, line_dedup, packing, quality, recompression, suffix_groups
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, h string, name string, n long, id long, rep long"
public_tokenizers = pytest.importorskip("public_tokenizers")


def az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def table(spark, docs):
    """The documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "x", 1, 2, None) for i, t in docs], SCHEMA)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Über", "日本語", "a|b"]
    base = [rng.choice(words) for _ in range(300)]
    docs = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(120))]
        if i % 3 == 0:
            s = rng.randrange(240)
            w[10:10] = base[s : s + rng.randrange(1, 60)]
        if i % 7 == 0:
            w += ["z"] * rng.randrange(60)
        if i % 5 == 0 and docs:
            w = (docs[-1][1] or "").split()
            if w:
                w[rng.randrange(len(w))] = "edit"
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "q " * 400), (103, docs[3][1]), (104, (docs[4][1] or "").upper()), (105, "a b"), (106, "A\tb\n"), (107, docs[6][1] + "\n" + docs[6][1]), (108, "x" * 5000)]
    docs.append(docs[8])  # a row that repeats
    return docs


def removed(pieces, window):
    seen = Counter(p[i : i + window] for p in pieces for i in range(len(p) - window + 1))
    out = []
    for p in pieces:
        gone = [False] * len(p)
        for i in range(len(p) - window + 1):
            if seen[p[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("window", [6, 35])
def test_recompression(spark, window):
    docs = corpus()
    pieces = [tuple((t or "").encode().split()) for _, t in docs]
    want = Counter((i, len(p), sum(g), b" ".join(w for w, x in zip(p, g) if not x).decode()) for (i, _), p, g in zip(docs, pieces, removed(pieces, window)))
    assert Counter(tuple(r) for r in recompression.drop_repeats(table(spark, docs), window=window).collect()) == want
    assert recompression.drop_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("window", [40, 200])
def test_suffix_groups(spark, window):
    docs = corpus(5)
    pieces = [(t or "").encode() for _, t in docs]
    want = Counter()
    for (i, _), p, g in zip(docs, pieces, removed(pieces, window)):
        spans = sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
        want[(i, len(p), sum(g), spans, bytes(b for b, x in zip(p, g) if not x))] += 1
    got = suffix_groups.drop_repeated_bytes(table(spark, docs), window=window).collect()
    assert Counter((*r[:4], bytes(r[4])) for r in got) == want


def test_suffix_array():
    rng = random.Random(1)
    for n in range(120):
        t = [rng.randrange(rng.choice([1, 2, 5, 50])) for _ in range(n)]
        assert suffix_groups.suffix_array(t) == sorted(range(n), key=lambda i: t[i:])


def test_exact_groups(spark):
    docs = corpus()
    by = defaultdict(list)
    for i, t in docs:
        by[az(t)].append(i)
    want = Counter((i, max(by[az(t)]), len(by[az(t)]), i == max(by[az(t)]), hashlib.sha256(az(t).encode()).hexdigest()) for i, t in docs)
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(table(spark, docs)).collect()) == want
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["mit"]
    docs = [(0, "Apache License, Apache License; cc-by 4.0"), (1, None), (2, ""), (3, f"Intro words here. {mit.upper()} and more"), (4, "mit licenses"), (5, "GNU General Public License"), (6, "é" * 3000), (7, "nothing of the kind at all")]
    got = {r.doc_id: r for r in license_scan.license_scan(table(spark, docs)).collect()}
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", az(t))
        at = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (got[i].n_words, got[i].n_base) == (len(w), len(at))
        assert (got[i].first_word, got[i].last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in at}))
    assert got[3].labels == "mit" and got[3].score == 1.0 and got[3].base_labels == ""
    assert got[7].labels == "" and got[7].score == 0.0


def test_quality(spark):
    rng = random.Random(2)
    docs = [*corpus(), (200, "the a of #*$ |&\n" * 12), (201, " ".join(rng.choice(["the", "of", f"w{i}"]) for i in range(400)))]
    got = quality.quality(table(spark, docs)).collect()
    assert len(got) == len(docs)
    for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(docs, key=lambda d: d[0])):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        rep = len({j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 8)})
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), rep, len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 20 or 100 * rep > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = [*corpus(), (300, "  a  b "), (301, "▁x ▁ y"), (302, "a\x00b\n\n c 😀"), (303, " "), (304, "</s> <s> <0x41>"), (305, " " * 99)]
    want = Counter()
    for i, t in docs:
        ids = sp.encode(t or "", add_eos=True)
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe_pieces.digests(table(spark, docs), path).collect()) == want
    coded = bpe_pieces.encode(table(spark, docs), path)
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == Counter((i, tuple(sp.encode(t or "", add_eos=True))) for i, t in docs)
    assert Counter((r.doc_id, r.text) for r in bpe_pieces.decode(coded, path).collect()) == Counter((i, sp.decode(sp.encode(t or ""))) for i, t in docs)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = [*corpus(), (300, "a<|endoftext|>b"), (301, "  x 　 y  z"), (302, "word " * 3000)]
    rows = packing.pack_documents(table(spark, docs), path).toPandas()
    want = Counter()
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : s + (1024 if k else first)]
            want[(i, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) + 1


def test_minimum_bin_slack():
    rng = random.Random(4)
    for _ in range(30):
        counts = Counter(rng.randrange(1, 101) for _ in range(rng.randrange(1, 200)))
        made = packing.minimum_bin_slack(dict(counts), 100)
        used = Counter()
        for items, times in made:
            assert sum(n * c for n, c in items.items()) <= 100
            used.update({n: c * times for n, c in items.items()})
        assert used == counts


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi <|end|> <\\|x"), (1, 1, "assistant", "ok </s>"), (2, 0, None, None), (2, 0, "assistant", "<|turn|>"), (3, 5, "system", ""), (1, 1, "assistant", "ok </s>"), (None, 0, "user", "<<|\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert len(out) == len(by)
    for r in out:
        want = sorted(by[r.conv_id])
        assert sorted((x.role, x.text) for x in r.back) == sorted((b, c) for _, b, c in want)
        said = [x.text for x in r.back if x.role == "assistant"]
        masked = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", m) for m in masked] == said
    parts = F.array(F.struct(F.lit("text").alias("type"), F.lit("see ").alias("text"), F.lit(None).cast("string").alias("ref")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("a.png").alias("ref")))
    one = chat_format.format_chats(df.filter("conv_id = 3"), parts=parts).first()
    assert "see <|image|>" in one.formatted and one.attachments[0].ref == "a.png" and one.expanded_tokens == chat_format.EXPANDED["image"]


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 420)] + [(500, k) for k in range(501, 600)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}


def test_jaccard(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(20):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 160))]
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append((len(docs), " ".join(w[: rng.randrange(len(w) * 3 // 4, len(w) + 1)])))
    docs += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A B"), (1004, "a b c"), (1005, "q " * 80), (1006, docs[3][1])]
    sets = {}
    for i, t in docs:
        w = az(t).encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) > 50
    root = roots(links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_copies(table(spark, docs)).collect()}
    assert got == {i: (len(s), root.get(i, i)) for i, s in sets.items()}


def test_line_dedup(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(30)) for _ in range(8)]
    near = lambda s: s.replace(s.split()[5], "edited", 1)
    docs = [(1, base[0] + "\n" + base[1]), (2, near(base[0]) + "\n\n" + base[2]), (3, base[1] + "\n" + base[3]), (4, None), (5, ""), (6, base[4] + "\n" + base[4]), (None, base[0])]
    got = {(r.doc_id, r["at"]) for r in line_dedup.repeated_lines(table(spark, docs)).collect()}
    assert got == {(2, 0), (3, 0), (6, 1)}
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(table(spark, docs)).collect()}
    assert kept[2] == "\n" + base[2] and kept[6] == base[4] and kept[4] is None and kept[None] == base[0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = ["the", "of", "and", *(f"word{i}" for i in range(500))]
    text = lambda n: " ".join(rng.choice(vocabulary[:3]) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(n))
    passage, clean = text(60), [text(150) for _ in range(12)]
    docs = [*enumerate(clean), (20, clean[0].upper()), (21, clean[1].replace(clean[1].split()[7], "edit", 1)), (22, text(80) + " " + passage), (23, passage + " " + text(90)), (24, "too short"), (25, None)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    stages, step = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        step = corpus_pipeline.written(f(spark, step, str(tmp_path)), "step")
        stages[name] = step
    ids = lambda name: {r.doc_id for r in stages[name].select("doc_id").collect()}
    assert ids("quality rules") == {*range(12), 20, 21, 22, 23}
    assert ids("exact dedup") == {*range(1, 12), 20, 21, 22, 23}
    assert ids("n-gram Jaccard join") == {*range(1, 12), 20, 22, 23}
    left = {r.doc_id: r.text for r in stages["substring dedup"].collect()}
    assert passage not in left[22] and passage not in left[23] and left[2] == clean[2]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() == stages["best-fit packing"].count() > 0


def test_lines_leave_no_shuffles(spark, monkeypatch):
    """Each stored step's shuffle files go with it, whether or not the driver's garbage is collected."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_(\d+)_", manager.getAllFiles().mkString(" ")))
    before, stored, written = files(), [], line_dedup.Scratch.written

    def watched(self, df, what, **options):
        out, until = written(self, df, what, **options), time.monotonic() + 5
        while (found := files() - before) and time.monotonic() < until:  # they go in the background
            time.sleep(0.1)
        assert not found
        stored.append(what)
        return out

    monkeypatch.setattr(line_dedup.Scratch, "written", watched)
    monkeypatch.setattr(line_dedup.Scratch, "release", lambda self: None)
    docs = [(i, f"some line of words that is much like others {i % 7}\nanother {i}") for i in range(40)]
    line_dedup.repeated_lines(table(spark, docs))
    assert "alike" in stored


def test_lines_without_spaces(spark):
    """All of a line counts, whether it has spaces or not."""
    urls = [f"https://example.org/a/b/{name}.html" for name in ("first", "zzz/other", "quite-another-page")]
    unlike = [*urls, "データの重複を取り除くための" + "長い日本語の文です" * 2, "データの重複を取り除くための" + "全く別の内容がここに続く"]
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(900))
    docs = [*enumerate([*unlike, long, long[:450] + "Z" + long[451:], "short", "shorn"])]
    got = {r.doc_id for r in line_dedup.repeated_lines(table(spark, docs)).collect()}
    assert got == {len(unlike) + 1}
    q = line_dedup.SHINGLE
    lines = spark.createDataFrame([(i, t) for i, t in docs], "id long, line string").select("id", F.size(line_dedup.shingles(line_dedup.code_points(F.col("line")))).alias("n"))
    assert {r.id: r.n for r in lines.collect()} == {i: len({t[k : k + q] for k in range(max(1, len(t) - q + 1))}) for i, t in docs}


@pytest.mark.parametrize("few", [10**6, 8])
def test_lines_with_boilerplate(spark, monkeypatch, few):
    """Alike lines whose bands are led by other lines, in bands with few lines and in crowded ones."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    boiler, lines = letters(200), []
    for _ in range(120):
        own = letters(100)
        lines += [boiler + own, boiler + "".join("#" if k in (15, 40, 65, 90) else c for k, c in enumerate(own))]
    rng.shuffle(lines)
    q = line_dedup.SHINGLE
    sets = [{t[k : k + q] for k in range(len(t) - q + 1)} for t in lines]
    head = list(range(len(lines)))
    for j in range(len(lines)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                head[j] = min(head[j], head[i])
    want = {i for i, h in enumerate(head) if h != i}
    assert len(want) == 120
    got = {r.doc_id for r in line_dedup.repeated_lines(table(spark, list(enumerate(lines)))).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_lines_of_two_groups(spark, monkeypatch):
    """Two groups of near copies whose texts are half alike: no pairs between them are made, all copies go, and the nearly alike line stays."""
    rng = random.Random(17)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared, own = letters(200), [letters(80), letters(80)]
    edited = lambda t: "".join("#" if k in (rng.randrange(len(t)),) else c for k, c in enumerate(t))
    lines = [edited(shared + own[k % 2]) for k in range(120)]
    made, stored = Counter(), line_dedup.Scratch.written

    def watched(self, df, what, **options):
        out = stored(self, df, what, **options)
        if what.startswith("pairs"):
            made[what] += out.count()
        return out

    monkeypatch.setattr(line_dedup.Scratch, "written", watched)
    got = {r.doc_id for r in line_dedup.repeated_lines(table(spark, list(enumerate(lines)))).collect()}
    assert got == set(range(2, 120))
    assert sum(made.values()) < 6 * len(lines)


@pytest.mark.parametrize("words", [1, 32])
def test_sketches_lose_no_pair(spark, monkeypatch, words):
    """Every alike pair passes the sketches, lines that repeat themselves and full sketches included."""
    monkeypatch.setattr(line_dedup, "WORDS", words)
    rng = random.Random(19)
    letters = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    lines, q = ["ab" * 40, "ab" * 30 + "c", "x", "xy", ""], line_dedup.SHINGLE
    for _ in range(25):
        t = letters(rng.randrange(8, 300))
        lines += [t, t[: rng.randrange(6, 9) * len(t) // 8], t + t, t.replace("a", "é", 1)]
    sets = [{t[k : k + q] for k in range(max(1, len(t) - q + 1))} for t in lines]
    want = {(j, i) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    frame = spark.createDataFrame(list(enumerate(lines)), "rep long, line string")
    sketches = line_dedup._sketches(frame)
    side = line_dedup._side
    both = side(sketches, "x").crossJoin(side(sketches, "y")).filter("x_rep > y_rep").filter(line_dedup._may_be_alike(75))
    passed = {(r.x_rep, r.y_rep) for r in both.select("x_rep", "y_rep").collect()}
    assert want and want <= passed
    pairs = spark.createDataFrame([(j, i) for j in range(len(lines)) for i in range(j)], "x long, y long")
    assert {(r.u, r.v) for r in line_dedup._alike(pairs, frame.join(sketches, "rep"), 75).collect()} == want


def test_repeated_rows(spark):
    """A row that stands twice stays once, and an id keeps the text of its own that no other row has."""
    long = " ".join(f"word{i}" for i in range(40))
    docs = [(1, long), (1, long), (2, "one"), (2, "two"), (3, "ONE"), (4, long), (4, long), (None, "two"), (None, "six"), (None, "six")]
    got = Counter((r.doc_id, r.text) for r in exact_dedup.drop_exact_copies(table(spark, docs)).collect())
    assert got == Counter([(4, long), (2, "two"), (3, "ONE"), (None, "six")])


def test_jaccard_repeated_ids(spark):
    """Rows with one id and different texts in one pack share their links; -1 is an id like others."""
    a, b, c = ([f"{k}{i}" for i in range(60)] for k in "abc")
    edit = lambda w: " ".join([*w[:-1], "edit"])
    docs = [(5, "a text that no other is like"), (1, " ".join(a)), (1, " ".join(b)), (2, edit(a)), (3, edit(b)), (-1, " ".join(c)), (9, edit(c))]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.near_copies(table(spark, docs).coalesce(1)).collect()}
    assert got == {(5, 5), (1, 1), (2, 1), (3, 1), (-1, -1), (9, -1)}


def test_chat_loss_mask(spark, sf_dir, monkeypatch):
    """op8's loss columns come from the operator's mask: they match the SQL, and with a wrong mask they don't."""
    import duckdb

    from tidemark.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    want = Counter(r for r in con.execute("SELECT conv_id, loss_chars, loss_sha256 FROM (" + queries.oracle_sql()["op8_chat_format"] + ")").fetchall())
    got = lambda: Counter(tuple(r) for r in queries.op8_chat_format(spark, sf_dir).select("conv_id", "loss_chars", "loss_sha256").collect())
    assert got() == want
    real = chat_format.format_chats
    monkeypatch.setattr(chat_format, "format_chats", lambda d: real(d, train_on="user"))
    assert got() != want
