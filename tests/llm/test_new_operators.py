"""Token alignment, phrase fingerprints and hard negatives against plain versions, with odd rows."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tensorloom.llm")

from tensorloom.llm import hard_negatives, lz_fingerprint, token_alignment  # noqa: E402
from tensorloom.llm import queries as Q  # noqa: E402
from tensorloom.llm.hard_negatives import ball_tree, interval, mine_hard_negatives, scores  # noqa: E402
from tensorloom.llm.lz_fingerprint import compare_neighbours, fingerprint, likeness, lz_fingerprints, phrase_likeness  # noqa: E402
from tensorloom.llm.token_alignment import align_tokens, linked, pair_counts, pieces  # noqa: E402

SF = "/root/testdata/sf0.001"
A, B = Q.tokenizer_path("byte_bpe_50k.json"), Q.tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    "Hello, wörld!  It's 12345\n\n  fine<|endoftext|> ok", "a\r\n b\t\tc \x1c d\x85e   f g　 h  ", "naïve 日本語のテキスト 🙂🙂 ᠎x", " ", "   lead", "tail \n", "x" * 700 + " ab" * 300,
    "under▁score", "<s> </s> <0x41> <unk>", "\x00\x01 nul", "a b c a b c", "A b C a B c", "​zero‍width é 힣", "don't we'll I'M 'tis ''s", "1 2 33  4444  5", "\n\n\n", "q\n r\n  s\n   t", None, "",
]


def plain_tokens(text):
    """(ids of A with bytes, ids of B with bytes) by the libraries, whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    for t in text:
        e = tok.encode(" " + (t or ""), add_special_tokens=False)
        a = [(i, bytes(of[c] for c in p)) for i, p in zip(e.ids, e.tokens, strict=True)]
        ids = sp.encode(t or "")
        b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, sp.id_to_piece(i)) for i in ids)]
        want = (" " + (t or "")).encode()
        good = bool(t) and b"".join(x for _, x in a) == want and b"".join(x for _, x in b) == want
        yield (a, b) if good else ([], [])


def plain_groups(a, b):
    ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b)]
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        out.append(([t for t, _ in a[i:x]], [t for t, _ in b[j:y]]))
        i, j = x, y
    return out


def plain_alignment(texts):
    groups = [plain_groups(a, b) for a, b in plain_tokens(texts)]
    links = [Counter(p for g in gs for p in itertools.product(*g)) for gs in groups]
    count = Counter(p for ls in links for p in ls)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    for gs, ls in zip(groups, links, strict=True):
        spelled = ";".join("|".join(",".join(map(str, side)) for side in g) for g in gs)
        yield (
            sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(ls.values()), sum(n for p, n in ls.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in ls.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if gs else "",
        )


def digested(aligned):
    out = linked(aligned.withColumn("sha", F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.lit(""))).drop("groups"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha")


@pytest.mark.parametrize("block", (20, 10**6))
def test_alignment_of_odd_texts(spark, block):
    rng = np.random.default_rng(5)
    letters = list("ab  \n\t'\"é日1.▁\x1c\x85 ") + [" the", " of", "ing", "'s", "<|endoftext|>"]
    texts = TEXTS + ["".join(rng.choice(letters, int(rng.integers(1, 40)))) for _ in range(200)]
    rows = [(i if i % 9 else None, t, "x", 3, [1]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, pair int, times array<int>")
    got = sorted(tuple(r)[1:] for r in digested(align_tokens(df, A, B, block=block)).collect())
    assert got == sorted(plain_alignment(texts))
    assert digested(align_tokens(df.limit(0), A, B)).count() == 0


def test_alignment_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, plain_alignment(list(texts.values())), strict=True))
    got = {r[0]: tuple(r)[1:] for r in Q.op11_token_alignment(spark, SF).collect()}
    assert got == want


def test_alignment_output(spark):
    df = spark.createDataFrame([(1, "unbelievable things"), (2, "things"), (3, None)], "doc_id long, text string")
    aligned = align_tokens(df, A, B)
    rows = {r.doc_id: r for r in aligned.collect()}
    (a, b), _, _ = plain_tokens(["unbelievable things", "things", None])
    assert rows[1].groups == ";".join("|".join(",".join(map(str, s)) for s in g) for g in plain_groups(a, b)) and rows[3].groups is None
    owners = [[i for i, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
    assert rows[1].n_overlaps == len(set(zip(*owners, strict=True)))
    shared = {(r.a, r.b): (r["count"], r.best) for r in pair_counts(aligned).collect()}
    assert max(n for n, _ in shared.values()) == 2 and all(b for n, b in shared.values() if n == 2)


@pytest.mark.parametrize("most", (1, 7, 50))
def test_pieces_of_long_texts(spark, monkeypatch, most):
    for t in TEXTS:
        assert "".join(pieces(" " + (t or ""), most)) == " " + (t or "")
    monkeypatch.setattr(token_alignment.pieces, "__defaults__", (most,))
    aligner = token_alignment.Aligner(A, B)
    texts = [t for t in TEXTS if t]
    counts, groups, *_ = aligner.block(texts)
    want = [plain_groups(a, b) for a, b in plain_tokens(texts)]
    assert [g or "" for g in groups] == [";".join("|".join(",".join(map(str, side)) for side in g) for g in gs) for gs in want]
    assert counts[:, 2].tolist() == [len(gs) for gs in want]


def plain_phrases(text):
    seen, s = set(), ""
    for c in text:
        s += c
        if s not in seen:
            seen.add(s)
            s = ""
    return seen


def test_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    long = " ".join(rng.choice(words, 5000))
    other = " ".join("".join(rng.choice(list("mnopqrst"), 5)) for _ in range(5000))
    for x, y in (("abcabcabc", "abcabd"), ("", ""), ("", "a"), ("aaaa", "aaaaaa")):
        p, q = plain_phrases(x), plain_phrases(y)
        assert phrase_likeness(fingerprint(x), fingerprint(y)) == (len(p & q) / len(p | q) if p | q else 1.0)
    p, q = plain_phrases(long), plain_phrases(long[:15000] + other[:5000])
    assert abs(phrase_likeness(fingerprint(long), fingerprint(long[:15000] + other[:5000])) - len(p & q) / len(p | q)) < 0.1
    assert phrase_likeness(fingerprint(long), fingerprint(other)) < 0.05 < phrase_likeness(fingerprint(long), fingerprint(long[::-1])) < 1
    # pieces and full dictionaries: a text fed in parts has the same fingerprint
    whole = fingerprint(long)
    monkeypatch.setattr(lz_fingerprint, "PIECE", 997)
    assert fingerprint(long) == whole
    monkeypatch.setattr(lz_fingerprint, "DICTIONARY", 100)
    emptied = lz_fingerprint.Parse().feed(long[:7777]).fork().feed(long[7777:])
    assert emptied.fingerprint() == fingerprint(long) != whole and len(emptied.seen) < 100
    monkeypatch.undo()
    df = spark.createDataFrame([(1, long, 1), (1, None, 2), (None, "", 3)], "doc_id long, text string, fingerprint int")
    prints = {r.fingerprint for r in lz_fingerprints(df).collect()}
    assert prints == {whole, ""}
    pairs = spark.createDataFrame([(whole, fingerprint(other)), (whole, None), ("", "")], "a string, b string")
    assert [r[0] for r in pairs.select(likeness(F.col("a"), F.col("b"))).collect()] == [phrase_likeness(whole, fingerprint(other)), None, 1.0]


def plain_neighbours(rows):
    """rows: (id, text) in order."""
    for (who, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        prints = [fingerprint(t) for t in (text, edited, after)]
        yield who, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1], phrase_likeness(prints[0], prints[1]), phrase_likeness(prints[0], prints[2])


def test_neighbours(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sorted(map(tuple, Q.op12_lz_fingerprint(spark, SF).collect()))
    assert got == sorted(plain_neighbours(sorted(texts.items())))
    assert np.mean([r[5] for r in got]) > 0.55 > 0.4 > np.mean([r[6] for r in got])
    odd = [(None, "nobody " * 9, "p", 1), (None, None, "p", 2), (3, "x" * 100_000, "p", 3), (3, "", "p", 4), (3, "", "p", 4), (9, "日本語 🙂 text", "p", 5), (-5, "minus", "p", 5)]
    df = spark.createDataFrame(odd, "doc_id long, text string, part string, n int")
    order = [(r.doc_id, r.t) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy("doc_id", F.xxhash64("t"), "t").collect()]
    key = lambda r: (r[0] is None, *r[1:], r[0] or 0)
    for ranges in (1, 3, 40):
        got = compare_neighbours(df, ranges=ranges)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_neighbours(order), key=key)
    one = compare_neighbours(df.where("n = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert compare_neighbours(df.where("n = 99")).count() == 0


def plain_negatives(rows, scale=1, positives=5, negatives=5, low=80, high=100):
    """rows: (id, label, vector); all rows by all rows."""
    rows = [(i, lab, [int(np.floor(scale * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (who, label, v) in enumerate(rows):
        if who % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), -i, m, lab) for m, (i, lab, w) in enumerate(rows) if len(w) == len(v)]
        best = sorted((s for s in scored if s[3] == label and s[2] != n), key=lambda s: (-s[0], -s[1]))[:positives]
        for p, pid, _, _ in best:
            hard = sorted((s for s in scored if s[3] != label and low * p <= 100 * s[0] <= high * p), key=lambda s: (-s[0], -s[1]))[:negatives]
            out += [(who, -pid, r, -i, p, s) for r, (s, i, _, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", (50, 10**6))
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 8))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 6] + 0.3 * rng.standard_normal(8)).tolist()) for i in range(700)]
    rows += [(1000 + 100 * i, 9, [1.0] * 8) for i in range(3)] + [(2001 + i, 1, [1.0] * 8) for i in range(20)]  # ties
    rows += [(100, 2, [0.5] * 8), (100, 2, [0.5] * 8), (5, None, [1.0] * 8), (None, 1, [1.0] * 8), (3000, 1, None), (3100, 1, []), (3200, 1, [float("nan")] * 8), (3300, 1, [None] * 8), (3400, 77, [1.0] * 8)]
    rows += [(4000 + i, i % 2, [1.0, 2.0]) for i in range(5)] + [(5000, 50, [2.0**60] * 8), (5001, 50, [-1.0] * 8), (5002, 51, [0.25] * 8)]
    df = spark.createDataFrame([(*r, "z", 1, 0.5) for r in rows], "vec_id long, label int, embedding array<double>, key string, row int, low double")
    far = [r for r in rows if r[0] != 5000]
    assert sorted(map(tuple, mine_hard_negatives(df.where("vec_id <> 5000 or vec_id is null"), F.col("vec_id") % 100 == 0, scale=16, block=block).collect())) == plain_negatives(far, 16)
    if block == 50:  # beyond doubles and within 64 bits
        small = [(100, 1, [2.0**29 + 1, 1.0]), (1, 1, [2.0**29 + 1, 0.0]), (2, 2, [2.0**29, 7.0]), (3, 2, [2.0**29, 6.0])]
        some = spark.createDataFrame(small, "vec_id long, label int, embedding array<double>")
        assert sorted(map(tuple, mine_hard_negatives(some, F.col("vec_id") % 100 == 0).collect())) == plain_negatives(small)
        assert mine_hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
        with pytest.raises(Exception, match="too large"):
            mine_hard_negatives(df, F.col("vec_id") % 100 == 0, scale=16, block=block).count()


def test_trees_and_scores():
    rng = np.random.default_rng(9)
    x, y = rng.integers(-300, 300, (900, 12)).astype(float), rng.integers(-300, 300, (500, 12)).astype(float)
    a, b = ball_tree(x, 16), ball_tree(y, 32)
    for i, j in zip(rng.integers(0, len(a.start), 200), rng.integers(0, len(b.start), 200), strict=True):
        low, high = interval(a, np.array([i]), b, np.array([j]))
        s = x[a.order[a.start[i] : a.end[i]]] @ y[b.order[b.start[j] : b.end[j]]].T
        assert low[0] <= s.min() and s.max() <= high[0]
    assert sorted(a.order) == list(range(900)) and (np.asarray(scores(x, y)) == x.astype(int) @ y.astype(int).T).all()
    same = ball_tree(np.ones((1000, 3)), 16)
    assert (same.end - same.start)[same.left < 0].max() <= 16


PLANTED = [
    ('{{"password": "{}"}}', "hunter2hunter2"), ('{{"api_key":"{}"}}', "abcdefGH12345678"), ("password   =   {} next", "swordfish99x"), ("token:\t{}", "abcdefgh1234"), ("secret=>{};", "abcdefgh1234"),
    ("password={}", "p@ssw0rd!long"), ("Authorization: Bearer {}", "eyJhbGciOi.abc-DEF_123"), ("?token={}&user=bobby1234", "abcdefgh12"), ("PWD := '{}'", "Tr0ub4dor&3xx"[:9]), ("mail jörg@x.org or {}", "anna.lena@example.com"),
    ("to {} and", "bob@" + "a" * 70 + ".com"), ("in {}", "a.b.c@example.co.uk"),
]
CLEAN = ["a basic understanding of Bearer certificates", "the password is secret", "tokens: few", "see section: overview", "x = 12345678901", "at 3:45 pm we met @home"]


def test_planted_secrets_are_found_by_a_plain_search(spark):
    """What is planted must be gone, whatever pattern found it; what surrounds it stays; the same value gets the same pseudonym."""
    from tensorloom.llm.pii import pseudonymise

    texts = [form.format(value) for form, value in PLANTED] + CLEAN + [f"again password={PLANTED[2][1]}", None]
    rows = [r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    for (form, value), text in zip(PLANTED, rows, strict=False):
        before, after = form.format("\0").split("\0")
        local = value.split("@")[0] if value.count("@") == 1 and "." in value.split("@")[1] else value
        assert local not in text and text.endswith(after) and (text.startswith(before) or "jörg" in before) and len(text) == len(form.format(value))
        assert [c.isdigit() for c in text] == [c.isdigit() for c in form.format(value)]
    assert "jörg" not in rows[9] and "@x.org" in rows[9]
    assert rows[len(PLANTED) : len(PLANTED) + len(CLEAN)] == CLEAN and rows[-1] is None
    assert rows[-2].split("=")[1] == rows[2].split("=   ")[1].split(" ")[0]


def test_language_sample_of_null_ids(spark):
    from tensorloom.llm import langid

    texts = [(None, f"the {i} and of words that follow here {i * 7}", "en") for i in range(600)] + [(None, f"der {i} und die wörter die folgen hier {i * 7}", "de") for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    sample = langid.F.xxhash64("doc_id", "text")
    share = df.where(F.pmod(sample, F.lit(1 << 30)) / float(1 << 30) <= 0.2).count()
    assert 150 < share < 330
    filters = langid.fit(df, per_language=100)
    got = {r.lang_pred for r in langid.identify(df.limit(50), filters).collect()}
    assert got <= {"en", "de"}


def test_language_scores_by_sets(spark):
    """The filters' answers, with the n-grams counted and rated in plain Python: rates above the floor, shares, and chances."""
    from tensorloom.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null")
    filters = langid.fit(docs.where(~Q.held_out()), per_language=10**9)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs.select("doc_id", "text"), filters).collect()}
    counts = defaultdict(Counter)
    learned = {r.doc_id for r in docs.where(~Q.held_out()).select("doc_id").collect()}
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    of = lambda t: langid.grams(list(langid.words_of(t)))[0].view(np.int64).tolist()
    for i in learned:
        counts[texts[i][1]].update(of(texts[i][0]))
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = Counter()
    for r in rate.values():
        for g, v in r.items():
            top[g] = max(top[g], v)
    sets = {lang: {g for g, v in r.items() if v >= 2e-5 and v >= 0.4 * top[g]} for lang, r in rate.items()}
    agree = 0
    for i, (t, _) in texts.items():
        gs = of(t)
        if gs:
            share = {lang: sum(g in s for g in gs) / len(gs) for lang, s in sets.items()}
            best = max(sorted(share), key=share.get)
            agree += got[i][0] == best and abs(got[i][1] - share[best]) < 0.05
        else:
            agree += got[i][0] == langid.UND
    assert agree >= 0.97 * len(texts)


def test_mixed_easy_copies_and_a_dense_group(spark):
    """Pairs whose only link is each other inside a dense group, beside as many copies that any pass finds."""
    from tensorloom.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    dense = unit(np.sqrt(0.85) * unit(rng.standard_normal(64)) + np.sqrt(0.15) * unit(rng.standard_normal((3000, 64))))
    across = rng.standard_normal((150, 64))
    across = unit(across - (across * dense[:150]).sum(1, keepdims=True) * dense[:150])
    pairs = unit(0.955 * dense[:150] + np.sqrt(1 - 0.955**2) * across)
    easy = unit(rng.standard_normal((2000, 64)))
    copies = unit(easy + 1e-3 * rng.standard_normal(easy.shape))
    x = np.concatenate([dense, pairs, easy, copies])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_vectors(df, window=256).collect()}
    hard = [(i, 3000 + i) for i in range(150) if near[i, 3000 + i]]
    assert len(hard) > 100 and all(got[3150 + i].component_id == got[5150 + i].component_id for i in range(2000))
    assert sum(got[i].component_id == got[j].component_id for i, j in hard) >= 0.97 * len(hard)


def test_planes_at_medians_of_all_vectors(spark):
    """each plane halves all vectors of a length, not a sample of them, also where most lie close together."""
    from tensorloom.llm import embedding_dedup as E

    rng = np.random.default_rng(77)
    x = np.vstack([rng.standard_normal(16) + 0.2 * rng.standard_normal((3500, 16)), rng.standard_normal((2501, 16))])
    rows = [(i, i, 16, r.tobytes()) for i, r in enumerate(x)] + [(9000 + i, i, 3, rng.standard_normal(3).tobytes()) for i in range(5)]
    entries = spark.createDataFrame(rows, "node long, h1 long, dim int, v binary").repartition(5)
    middles = E._middles(entries, [16], range(2), 2026, "<f8")
    keys = entries.mapInArrow(E._keys(middles, range(2), 2026, "<f8"), "pass int, dim int, key long, node long, h1 long").where("dim = 16").toPandas()
    assert len(keys) == 2 * len(x) and set(middles) == {(16, 0), (16, 1)}
    for _, one in keys.groupby("pass"):
        above = (one["key"].to_numpy()[:, None] >> np.arange(E.BITS)) & 1
        assert np.abs(above.mean(axis=0) - 0.5).max() < 0.002
