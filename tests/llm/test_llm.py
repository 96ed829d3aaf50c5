"""The ten operators against brute force, libraries or round trips, with odd rows: null, empty, blank, repeated, clashing columns."""

import datetime
import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

pytest.importorskip("tensorloom.llm")

import corpus_pipeline  # noqa: E402
from tensorloom.llm import ngram_join, pii  # noqa: E402
from tensorloom.llm import queries as Q  # noqa: E402
from tensorloom.llm.chat import chains, format_chats, masked_text, parse_turns, reply_paths  # noqa: E402
from tensorloom.llm.embedding_dedup import near_vectors  # noqa: E402
from tensorloom.llm.exact_dedup import DigestIndex, exact_dedup  # noqa: E402
from tensorloom.llm.langid import fit, identify  # noqa: E402
from tensorloom.llm.packing import nnls, pack  # noqa: E402
from tensorloom.llm.pii import pseudonymise  # noqa: E402
from tensorloom.llm.sentencepiece_codec import SentencePieceEncoder, sentencepiece_decode, sentencepiece_encode  # noqa: E402
from tensorloom.llm.sharding import permute, row_at, shard  # noqa: E402
from tensorloom.llm.tokens import ChunkEncoder  # noqa: E402
from tensorloom.llm.url_filter import Cascade, url_filter  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f g h i j"), (2, "A b c d e f g h i j"), (2, "x"), (3, None), (4, ""), (5, " \t"), (None, "a b c"), (6, "a b"), (7, "a b"), (8, "w " * 3000)]


re_java = regex.compile(pii.ALL, regex.A)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "z", 5) for r in ODD], "doc_id long, text string, n long, node string, token int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_chat(spark):
    m = spark.createDataFrame([("r", None, 1, "user", "q", 1.0), ("a", "r", 1, "assistant", "x### <", 0.1), ("b", "r", 1, "assistant", None, 0.9), ("c", "b", 1, "us:er", "\\h", 0.0)], "node string, parent string, tree long, role string, text string, score double")
    best = reply_paths(m, best=1).first()
    assert [t.text for t in best.turns] == ["q", None, "\\h"] and best.leaf == "c"
    rows = format_chats(m).withColumn("t", parse_turns(F.col("formatted"))).withColumn("l", masked_text(F.col("formatted"), F.col("loss"))).orderBy("leaf").collect()
    assert [[(t.role, t.text) for t in r.t] for r in rows] == [[("user", "q"), ("assistant", "x### <")], [("user", "q"), ("assistant", ""), ("us:er", "\\h")]]
    assert [r.l for r in rows] == ["x### <", ""]
    assert format_chats(m.limit(0)).count() == 0


def test_chat_odd_rows(spark):
    kind = "node string, parent string, tree long, role string, text string, score double, up string, branch int, leaf int"
    rows = [("q", None, 1, "user", "q", None), ("x", "q", 1, None, "x" * 100_000, 1.0), ("y", "q", 1, "assistant", "y", 1.0), ("y", "q", 1, "assistant", "y", 1.0), ("z", "gone", 2, "user", None, None)]
    rows += [("s", "s", 3, "user", "self", 0.0), ("t", "s", 3, "user", "below", 0.0), (None, "q", 1, "user", "no name", 0.0)]
    rows += [(f"c{i}", f"c{(i + 1) % 50}", 4, "user", "ring", 0.0) for i in range(50)] + [(f"l{i}", f"c{i % 50}", 4, "user", "leaf", 0.0) for i in range(100)]
    df = spark.createDataFrame([(*r, "u", 7, 8) for r in rows], kind)
    got = {r.leaf: (r.path_rank, [t.text for t in r.turns]) for r in reply_paths(df, best=1).collect()}
    assert got == {"x": (1, ["q", "x" * 100_000]), "z": (1, [None])}  # of equal scores the smaller name
    assert {r.leaf: len(r.turns) for r in reply_paths(df).collect()} == {"x": 2, "y": 2, "z": 1}
    assert reply_paths(df.limit(0)).count() == 0
    talk = spark.createDataFrame([(5, 1, "user", "b", 0), (5, None, "user", "a", 0), (5, 1, "user", "b", 0), (None, 2, None, None, 0)], "conv_id long, turn long, role string, text string, at int")
    assert {r.tree: [t.text for t in r.turns] for r in reply_paths(chains(talk)).collect()} == {5: ["a", "b", "b"], None: [None]}


def test_sharding(spark, odd):
    for n in (1, 2, 7, 1000):
        p = permute(np.arange(n), n, 5)
        assert sorted(p) == list(range(n)) and (permute(p, n, 5, inverse=True) == np.arange(n)).all()
    rows = shard(odd, 4).collect()
    assert len(rows) == len(ODD) and sorted((r.shard, r.slot) for r in rows) == sorted((i % 4, i // 4) for i in range(len(ODD)))
    assert all(row_at(np.array([r.shard]), np.array([r.slot]), len(ODD), 4, 2026)[0] == r.row for r in rows)
    assert shard(odd.limit(0), 4).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((5, 16))
    x = [(base[i % 5] + 0.05 * rng.standard_normal(16)).tolist() for i in range(60)] + [base[0].tolist()] * 3 + rng.standard_normal((30, 16)).tolist()
    x += [None, [0.0] * 16, [float("nan")] * 16, []]
    df = spark.createDataFrame([(i, v, "k") for i, v in enumerate(x)], "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    m = np.array([v if v and len(v) == 16 and any(v) and np.isfinite(v).all() else [0] * 16 for v in x])
    size = np.linalg.norm(m, axis=1)
    near = m @ m.T / np.maximum(np.outer(size, size), 1e-300) >= 0.95
    np.fill_diagonal(near, False)
    comp = list(range(len(x)))
    for _ in range(len(x)):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(near[i].sum(), comp[i]) for i in range(len(x))]


def vector_links(x):
    """Links and components of unit vectors by brute force."""
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    a, b = np.nonzero(near)
    while True:
        before = comp.copy()
        np.minimum.at(comp, a, before[b])
        if (comp == before).all():
            return near, comp
        comp = comp[comp]


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_vectors_of_a_dense_group(spark):
    # mutual cosines near 0.9, and pairs whose only link is each other, in windows of a sixteenth of the rows
    rng = np.random.default_rng(7)
    x = unit(np.sqrt(0.9) * unit(rng.standard_normal(64)) + np.sqrt(0.1) * unit(rng.standard_normal((8000, 64))))
    across = rng.standard_normal((400, 64))
    across = unit(across - (across * x[:400]).sum(1, keepdims=True) * x[:400])
    x = np.concatenate([x, 0.955 * x[:400] + np.sqrt(1 - 0.955**2) * across])
    near, _ = vector_links(x)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), window=512).collect()}
    found, links = sum(r.n_links for r in got.values()), near.sum()
    assert 0.95 * links <= found <= links and all(r.n_links <= near[i].sum() for i, r in got.items())
    together = [got[i].component_id == got[8000 + i].component_id for i in range(400)]
    assert near[:400, 8000:].diagonal().all() and np.mean(together) >= 0.95


def test_vectors_of_a_large_component(spark):
    # a component of several windows: tight vectors, outer ones and strangers; copies count
    rng = np.random.default_rng(8)
    c = unit(rng.standard_normal(32))
    x = np.concatenate([unit(c + s * unit(rng.standard_normal((m, 32)))) for s, m in ((0.05, 700), (0.2, 300), (0.3, 150))] + [unit(rng.standard_normal((200, 32)))])
    x = np.concatenate([x, x[:5], x[:5]])
    near, comp = vector_links(x)
    got = near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), window=256).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == near.sum(1).tolist() and [r.component_id for r in got] == comp.tolist()


def test_vectors_odd(spark):
    kind = "vec_id long, embedding array<float>, comp string, copies int, h1 int, pass int"
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [-0.0, 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, None), (7, [1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [1e-38, 0.0])]
    got = near_vectors(spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], kind)).collect()
    # both rows of id 1 are one vertex, and so are [1, 0] and [0, 1]; 1e-38 points as [1, 0] does
    assert sorted((r.vec_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (7, 7, True), (8, 1, False)]
    assert near_vectors(spark.createDataFrame([], kind)).count() == 0


def brute_components(rows, k, percent):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    sets = [frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]) for w in (words(t) for _, t in rows)]
    comp = {i: i for i, _ in rows}
    while True:
        before = dict(comp)
        for (i, _), a in zip(rows, sets, strict=True):
            for (j, _), b in zip(rows, sets, strict=True):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            return comp, [len(s) for s in sets]


@pytest.mark.parametrize("block", (300_000, 50))
def test_ngram_join(spark, docs, odd, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    comp, sizes = brute_components(rows, 4, 85)
    got = ngram_join.ngram_jaccard_join(docs, 4, 85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, n, comp[i]) for (i, _), n in zip(rows, sizes, strict=True)}
    got = ngram_join.ngram_jaccard_join(odd).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (None, None), (6, 6), (7, 6), (8, 8)}
    assert ngram_join.ngram_jaccard_join(odd.limit(0)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    from tensorloom.llm import common

    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcDE \t"), int(n))) for n in rng.integers(0, 400, 60)] + ["x" * 700, " " * 300, "a" * 100 + " " + "b" * 200, None, ""]
    whole = [s.tolist() for s in common.doc_shingles(pa.array(texts), 3)]
    monkeypatch.setattr(common, "_PIECE", 50)
    monkeypatch.setattr(common, "_POWERS", [])
    assert [s.tolist() for s in common.doc_shingles(pa.array(texts), 3)] == whole


def test_ngram_join_hot_token(spark):
    # a third of the rows are near copies of one text, each its own
    same = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join([*same, f"only{i}"]) if i % 3 == 0 else " ".join(f"w{i}x{j}" for j in range(20))) for i in range(1500)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert all(r.component_id == (0 if r.doc_id % 3 == 0 else r.doc_id) for r in got)


def test_ngram_join_small_batches(spark, monkeypatch):
    # 12 MB of texts in one partition come to a worker in batches of 2 MB, and the session's own setting comes back
    from tensorloom.llm import common

    shingles = common.doc_shingles

    def watched(column, k):
        if sum(b.size for b in column.buffers() if b) > 4 << 20:
            raise ValueError("a large batch")
        yield from shingles(column, k)

    monkeypatch.setattr(ngram_join, "doc_shingles", watched)
    words = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.hex(F.xxhash64(i, "id")))
    own = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = ngram_join.ngram_jaccard_join(spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text")), 4, 85).collect()
    assert len(got) == 2500 and all(r.component_id == r.doc_id and r.n_shingles == 297 for r in got)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == own


def test_shingles_need_little_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from tensorloom.llm import common

    monkeypatch.setattr(common, "_POWERS", [])
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(500)) for i in range(1000)])
    tracemalloc.start()
    assert sum(len(s) for s in common.doc_shingles(texts, 4)) == 1000 * 497
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_language(spark, docs, odd):
    filters = fit(docs.where(~Q.held_out()))
    got = identify(docs, filters).where(Q.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in identify(odd, filters).where("text is null or trim(text) = '' or trim(text) = chr(9)").collect()] == ["und"] * 3
    none = identify(odd, fit(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_language_clashing_and_long(spark, docs):
    filters = fit(docs)
    text = docs.where("lang is not null and length(text) > 2000").first()
    rows = [(1, text.text.replace(" ", ""), "old", 3), (2, text.text * 20, "old", 4), (2, text.text * 20, "old", 4), (None, "\u4e2d\u6587" * 20_000, None, None)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score int"), filters)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and [r.lang_pred == text.lang for r in got.collect()][:3] == [True] * 3
    assert identify(docs.limit(0), filters).count() == 0


def test_more_languages_than_a_word_has_bits(spark):
    # the language of number i has words of its own letters; the last ones are the rarest
    rng = np.random.default_rng(5)
    word = lambda i: "".join(chr(0x4E00 + 40 * i + int(x)) for x in rng.integers(0, 12, 5))
    rows = [(100 * i + j, " ".join(word(i) for _ in range(40)), f"l{i:03d}") for i in range(70) for j in range(3 if i < 64 else 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4)
    filters = fit(df)
    assert filters.languages == [f"l{i:03d}" for i in range(70)] and len(filters.table) == 2
    assert all(r.lang == r.lang_pred for r in identify(df, filters).collect())


def test_sharding_query(spark):
    """The whole query against plain numbers: order, permutation with cycle walking, sizes and checksums."""
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, m = len(rows), 2**64 - 1
    half = (n - 1).bit_length() + 1 >> 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    def at(x):
        while True:
            left, right = x >> half, x % (1 << half)
            for i in range(1, 7):
                left, right = right, left ^ mix(right + mix(i * 0x9E3779B97F4A7C15 + 2026 & m) & m) % (1 << half)
            x = left << half | right
            if x < n:
                return x

    ranked = sorted((i, zlib.crc32(t), len(t) + 16) for i, t in rows)
    want = [(i, size, crc, "rows", at(k) % 40, at(k) // 40, None) for k, (i, crc, size) in enumerate(ranked)]
    got = Q.op2_feistel_sharding(spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_sharding_odd(spark):
    df = spark.createDataFrame([(None, None, 1, "r"), (None, None, 2, "r"), (7, "\u00e9", 3, "r"), (7, "\u00e9", 3, "r"), (-1, "", 4, "r")], "doc_id long, text string, shard int, row string")
    rows = shard(df, 3).orderBy("row").collect()
    assert [(r.doc_id, r.size, r.text_crc32) for r in rows] == [(None, 16, 0), (None, 16, 0), (-1, 16, 0), (7, 18, zlib.crc32("\u00e9".encode())), (7, 18, zlib.crc32("\u00e9".encode()))]
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def prf(kind, turn, value, key=Q.PII_KEY):
    return int(hashlib.sha256(f"{key}|{kind}|{turn}|{value}".encode()).hexdigest()[:15], 16)


def pair(kind, a, b, na, nb):
    for t in range(8):
        a, b = ((a + prf(kind, t, b)) % na, b) if t % 2 == 0 else (a, (b + prf(kind, t, a)) % nb)
    return a, b


def digit_string(kind, d):
    u = len(d) // 2
    a, b = pair(kind, int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
    return f"{a:0{u}d}{b:0{len(d) - u}d}"


def letter_string(kind, x):
    half = (len(x) + 1) // 2
    a, b = x[:half], x[half:]

    def shifted(own, other, t):
        other = hashlib.sha256(other.encode()).hexdigest() if len(other) > 256 else other
        out = ""
        for i, c in enumerate(own):
            base, n = (48, 10) if c in "0123456789" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (ord(c), 1)
            out += chr(base + (ord(c) - base + prf(kind, t, f"{i + 1}|{other}")) % n)
        return out

    for t in range(4):
        a, b = (shifted(a, b, t), b) if t % 2 == 0 else (a, shifted(b, a, t))
    return a + b


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def refill(form, d):
    return re.sub("[0-9]", lambda _, it=iter(d): next(it), form)


def pseudonym(x):
    """(kind, pseudonym) of a found value in plain Python; None where it is not valid."""
    d, full = re.sub("[^0-9]", "", x), lambda p: regex.fullmatch(p, x, regex.A)
    if "@" in x:
        name, domain = x.split("@")
        return "email", f"{letter_string('email', name)}@{domain}"
    if full(pii.CARD) and 13 <= len(d) <= 19 and luhn(d) == 0:
        new = digit_string("card", d[:-1])
        return "card", refill(x, new + str(-luhn(new + "0") % 10))
    if full(pii.IPV4):
        o = [int(p) for p in x.split(".")]
        if any(v > 255 or str(v) != p for v, p in zip(o, x.split("."), strict=True)):
            return None
        a, b = pair("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return "ipv4", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if full(pii.DATE):
        try:
            day = (datetime.date.fromisoformat(x) - datetime.date(1700, 1, 1)).days
        except ValueError:
            return None
        if not 0 <= day < 146097:
            return None
        a, b = pair("date", day // 773, day % 773, 189, 773)
        return "date", str(datetime.date(1700, 1, 1) + datetime.timedelta(a * 773 + b))
    if full(pii.SSN):
        area, group, serial = map(int, x.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        a, b = pair("ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 989901)
        return "ssn", f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if full(pii.PHONE):
        area, rest = int(d[-10:-7]), int(d[-7:])
        if area >= 200 and rest >= 2_000_000:
            a, b = pair("phone", area - 200, rest - 2_000_000, 800, 8_000_000)
            new = f"{a + 200}{b + 2_000_000}"
        else:
            n = area * 10**7 + rest if area < 200 else 2 * 10**9 + (area - 200) * 2_000_000 + rest
            a, b = pair("phone_other", n // 60000, n % 60000, 60000, 60000)
            n = a * 60000 + b
            new = f"{n:010d}" if n < 2 * 10**9 else f"{(n - 2 * 10**9) // 2_000_000 + 200}{(n - 2 * 10**9) % 2_000_000:07d}"
        return "phone", refill(x, d[:-10] + new)
    if full(pii.ABROAD):
        return "abroad", refill(x, d[:2] + digit_string("abroad", d[2:]))
    if full(pii.KEY_ID):
        return "key_id", x[:4] + letter_string("key", x[4:])
    return None if full(pii.CARD) else ("secret", letter_string("secret", x))


def without_pii(text):
    kinds = []

    def new(found):
        told = pseudonym(found[0])
        kinds.extend([told[0]] if told else [])
        return told[1] if told else found[0]

    return re_java.sub(new, text), kinds


def test_pii_query(spark):
    """Every row of the query against plain Python."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op6_pii_pseudonyms(spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_found for r in got) > 50
    for r in got:
        want, kinds = (None, []) if texts[r.doc_id] is None else without_pii(texts[r.doc_id])
        assert (r.text, r.n_found, r.kinds) == (want, len(kinds), ",".join(kinds))


def test_pii_odd(spark):
    kind = "doc_id long, text string, __values int, found string, __found string"
    df = spark.createDataFrame([(None, "mail " + "a.b" * 50 + "c@x.org", 1, "f", "g"), (1, "-.j--k@x.org x", 2, "f", "g"), (1, "-.j--k@x.org x", 2, "f", "g"), (2, "a-" * 200_000 + "b", 3, "f", "g")], kind)
    got = pseudonymise(df, Q.PII_KEY).collect()
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [(None, 1, "f", "g"), (1, 2, "f", "g"), (1, 2, "f", "g"), (2, 3, "f", "g")]
    assert got[0].text == "mail " + letter_string("email", "a.b" * 50 + "c") + "@x.org" and got[1].text == got[2].text == "-." + letter_string("email", "j--k") + "@x.org x"
    assert pseudonymise(df.limit(0), "key", found_col="found").count() == 0


def test_pii(spark):
    texts = ["a.b12@x.org +1 (269) 555-3296 4524132264652876 55.63.178.142", "1984-02-29 1984-03-01 2023-02-30 123-45-6789 4524132264652877", "4524-1322-6465-2876 password=7602ad27cf5550de1c", None, "", "plain"]
    rows = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key", found_col="found").orderBy("doc_id").collect()
    kinds = [[f.kind for f in r.found] for r in rows]
    assert kinds == [["email", "phone", "card", "ipv4"], ["date", "date", "ssn"], ["card", "secret"], [], [], []]
    assert [r.text for r in rows[3:]] == [None, "", "plain"] and "2023-02-30" in rows[1].text and "4524132264652877" in rows[1].text
    card = rows[0].found[2].pseudonym
    digits = [int(c) for c in card[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert rows[2].found[0].pseudonym.replace("-", "") == card
    for r in rows:
        for f in r.found:
            assert f.value not in r.text and re.sub(r"\d", "9", f.value).count("9") == re.sub(r"\d", "9", f.pseudonym).count("9") or f.kind == "ipv4"


def test_pii_any_area_code(spark):
    phones = ["+1 (017) 555-7713", "+1 (136) 555-7479", "(017) 155-7713", "+1-017-555-7713", "+10175557713", "(269) 155-3296", "+1 (269) 555-3296", "269-555-3296"]
    rows = pseudonymise(spark.createDataFrame([(i, f"call {p}.") for i, p in enumerate([*phones, "017-555-7713"])], "doc_id long, text string"), "key", found_col="found").orderBy("doc_id").collect()
    found = [r.found for r in rows]
    assert [[(f.kind, f.value) for f in fs] for fs in found] == [[("phone", p)] for p in phones] + [[]]
    new = [re.sub(r"\D", "", fs[0].pseudonym)[-10:] for fs in found[:-1]]
    assert all(re.sub(r"\d", "9", fs[0].pseudonym) == re.sub(r"\d", "9", fs[0].value) and fs[0].pseudonym not in phones for fs in found[:-1])
    assert new[0] == new[3] == new[4] and new[6] == new[7] and len(set(new)) == 5  # a number has one pseudonym in all forms
    # the permutation's two parts stay apart
    assert [n[0] >= "2" and n[3] >= "2" for n in new] == [False] * 6 + [True] * 2


def test_pii_secrets_whole(spark):
    long = "".join("aB3_xyZ9"[i % 7] for i in range(100_000))
    secrets = ["9233A8EC9233A8EC", "hunter2hunter2", "aaaa.bbbb.cccc", long, "x" * 513, "a.bcdefg"]
    texts = [f'TOKEN = "{secrets[0]}"', f"Password: {secrets[1]}, then", f"token={secrets[2]}. End", f"Api_Key: {secrets[3]}", f"secret='{secrets[4]}'", f"pwd={secrets[5]}", "pwd=a.bcdef", "Token: short."]
    rows = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key", found_col="found").orderBy("doc_id").collect()
    assert [[(f.kind, f.value) for f in r.found] for r in rows] == [[("secret", s)] for s in secrets] + [[], []]
    for r, t, s in zip(rows, texts, secrets, strict=False):
        new = r.found[0].pseudonym
        assert new != s and len(new) == len(s) and r.text == t.replace(s, new) and [c.isalnum() for c in new] == [c.isalnum() for c in s]
        assert not any(p in r.text for p in s.split(".") if len(p) > 3)
    assert [r.text for r in rows[6:]] == texts[6:]


def test_exact(spark, odd, tmp_path):
    index = DigestIndex(spark, "digests_test", buckets=4, location=str(tmp_path / "index"))
    first = exact_dedup(odd, index, "one").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in first if r.doc_id in (1, 2, 3, 4)} == {(1, 2, 2, False), (2, 2, 2, True), (2, 2, 1, True), (3, 4, 2, False), (4, 4, 2, True)}
    assert [(r.keep_id, r.kept) for r in first if r.doc_id is None] == [(None, True)]
    again = exact_dedup(odd, index, "two").collect()
    assert not any(r.kept for r in again) and len(again) == len(ODD)
    more = spark.createDataFrame([(9, "A B C D E F G H I J"), (9, "new"), (9, "NEW"), (8, "new"), (None, "new"), (9, "new")], "doc_id long, text string")
    got = exact_dedup(more, index, "three").collect()
    assert [(r.keep_id, r.group_size) for r in got] .count((9, 5)) == 5 and sum(r.kept for r in got) == 1
    assert exact_dedup(odd.limit(0), index, "four").count() == 0
    before = index.table().count()
    index.compact()
    assert index.table().count() == before and DigestIndex(spark, "digests_test", buckets=9).buckets == 4
    assert not any(r.kept for r in exact_dedup(odd, index, "five").collect())
    index.drop()


def test_exact_hot_group(spark, tmp_path):
    # half of all rows share a text, and no task of a shuffle gets more than a fraction of them
    index = DigestIndex(spark, "digests_hot", location=str(tmp_path / "index"), rows=20_000)
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("text"))
    out = exact_dedup(docs, index, "one")
    assert out.where("kept").count() == 20_001 and out.where("keep_id = 39999 and group_size = 20000").count() == 20_000
    widest = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.when(F.col("group_size") > 1, 1)).alias("n")).agg(F.max("n")).first()[0]
    assert widest <= 20_000 // 2
    index.drop()


def test_urls(spark):
    urls = [None, "nothing", "http://www.EXAMPLE.com/en/a?x", "https://a.example.com/en/", "http://b.net/fr/x#y", "http://com/", "http://xcom/", "ftp://a.example.com/fr"]
    df = spark.createDataFrame([(i, u, "h", "k", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, keys string, hashes int")
    rows = url_filter(df, Q.RULES).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [(None, "allow"), (None, "allow"), ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/fr/", "block"), ("com/", "allow"), (None, "allow"), ("com/", "allow")]
    assert url_filter(df.limit(0), Q.RULES).count() == 0 and {r.verdict for r in url_filter(df, [], "block").collect()} == {"block"}
    odd = spark.createDataFrame([(None, "http://net/es/" + "x" * 100_000), (None, "http://net/es/" + "x" * 100_000), (1, "")], "page_id long, url string")
    assert sorted((r.page_id or 0, len(r.path), r.verdict) for r in url_filter(odd, Q.RULES).collect()) == [(0, 100_004, "block")] * 2 + [(1, 0, "allow")]


def test_url_cascade(monkeypatch):
    # many levels: a first level so small that it lets much through
    import sys

    monkeypatch.setattr(sys.modules["tensorloom.llm.url_filter"], "FIRST", 64)
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(-(2**63), 2**63, 4000))
    listed, others = keys[::3], np.delete(keys, np.s_[::3])
    member = Cascade(listed, lambda has: others[has(others)], first_bits=2)
    assert len(member.levels) > 2 and (member.has(keys) == np.isin(keys, listed)).all()


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for table in (docs, odd.where("doc_id is not null and doc_id <> 2")):
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        rows = pack(table, path, 2).toPandas()
        for r in rows.itertuples():
            ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert (rows.groupby("doc_id").length.sum() == rows.groupby("doc_id").doc_tokens.first()).all() and set(rows.doc_id) == set(texts)
        rows = rows.sort_values(["sequence_id", "offset"])
        assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all() and rows.groupby("sequence_id").length.sum().max() <= 4096
    assert pack(docs.limit(0), path, 2).count() == 0
    a, b = np.random.default_rng(1).random((6, 9)), np.arange(6.0)
    x = nnls(a, b)
    assert (x >= 0).all() and (a.T @ (b - a @ x) < 1e-6).all()


def test_separators_are_tokens():
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), ChunkEncoder(path)
    texts = [t.replace("|", c) for c in "\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000" for t in ("abc|def", "|", "a |b c| d", "||x", "Caf\u00e9|<b|> 12|3 it's|", "<|endoftext|>")]
    assert tokenizer.encode("abc\x1cdef", add_special_tokens=False).ids == [5334, 472, 11649]
    assert [e.tolist() for e in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def heap_merges(pieces, word):
    """BPE of one word by the definition, written apart: the best pair first, the left one among equals."""
    part, n = list(word), len(word)
    left, right, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

    def offer(i):
        if right[i] >= 0 and (found := pieces.rank.get(part[i] + part[right[i]])):
            heapq.heappush(heap, (-found[0], i, part[i], part[right[i]]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if part[i] != a or j < 0 or part[j] != b:
            continue
        part[i], part[j], right[i] = a + b, "", right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [x for p in part if p for x in ([pieces.rank[p][1]] if len(p) > 1 else pieces._spell(p))]


def test_sentencepiece(spark, docs, odd):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = Q.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for table in (docs, odd):
        rows = sentencepiece_encode(table, path).collect()
        texts = [r.text for r in table.collect()]
        assert [r.ids for r in rows] == [None if t is None else library.encode(t) for t in texts]
        assert [r.text for r in sentencepiece_decode(sentencepiece_encode(table, path), path).collect()] == texts
    # Viterbi over pairs that stay apart gives the merges' result: random letters, joined pieces, runs of spaces
    pieces, rng = SentencePieceEncoder(path).pieces, np.random.default_rng(6)
    ids = pieces.ids[: len(pieces.plain)]
    assert pieces.made[ids].all()
    letters = np.array([t for t in (pieces.text[i] for i in ids) if len(t) == 1])
    words = ["".join(rng.choice(letters, n)) for n in range(1, 30) for _ in range(20)] + ["".join(rng.choice(list("aeinrstb\u2581"), n)) for n in range(1, 40) for _ in range(50)]
    words += ["".join(pieces.text[i] for i in rng.choice(ids, n)) for n in range(1, 6) for _ in range(400)] + [c * n for c in "ab\u2581\U0001f9ff" for n in range(1, 50)]
    for n in {len(w) for w in words}:
        some = [w for w in words if len(w) == n]
        assert pieces.viterbi(some) == pieces.merges(some) == [heap_merges(pieces, w) for w in some] == pieces.long_paths(some)
    # long words in stretches: texts without spaces, runs of one letter, random letters, characters that no piece has
    whole = "".join(r.text for r in docs.limit(60).collect() if r.text).replace(" ", "\u2581")
    words = [whole[i : i + n] for i, n in ((0, 257), (300, 512), (0, 20_000))] + [c * n for c in ("a", "ab", "\u2581", "\U0001f9ff", "in", "the") for n in (300, 2000)]
    words += ["".join(rng.choice(list("aeinrstb\u2581\U0001f9ff"), n)) for n in (256, 257, 272, 513, 5000) for _ in range(3)]
    words += ["".join(rng.choice(list("at"), 4000)), "".join(pieces.text[i] for i in rng.choice(ids, 3000))]
    assert pieces.long_paths(words) == [heap_merges(pieces, w) for w in words]
    assert sentencepiece_decode(sentencepiece_encode(odd.limit(0), path), path).count() == 0
    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40000) / 2000 - 0.001 * len(p.piece)
    raw = model.SerializeToString()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), SentencePieceEncoder(raw)
    for t in [r.text for r in docs.limit(40).collect()]:
        a, b = (sum(library.get_score(int(i)) for i in ids) for ids in (own.encode([t])[0], library.encode(t)))
        assert abs(a - b) < 1e-3 * max(1, abs(b))  # ties may differ, totals don't


def test_language_query(spark):
    got = Q.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out and r.lang and r.lang_pred != "und"]) > 0.98


def check_packed(rows, texts):
    """The contract of packing for rows as a table, and texts by id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    seen: dict = {}
    for r in rows.itertuples():
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(seen) == set(texts)
    for i, parts in seen.items():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist()
    rows = rows.sort_values(["sequence_id", "offset"])
    sums = rows.groupby("sequence_id").length
    assert (sums.cumsum() - rows.length == rows.offset).all() and sums.sum().max() <= 4096


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packed(Q.op9_packing(spark, SF).toPandas(), texts)


def test_packing_odd(spark):
    rows = [(None, "a b"), (None, "a b"), (4, None), (4, None), (4, "x " * 9000), (5, "")]
    got = pack(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, cls int, part int"), Q.tokenizer_path("word_bpe_49k.json"), 2).collect()
    pieces = sorted((r.doc_id or 0, r.doc_tokens, r.start, r.length) for r in got)
    assert pieces == [(0, 3, 0, 3)] * 2 + [(4, 1, 0, 1)] * 2 + [(4, 9001, 0, 4096), (4, 9001, 4096, 4096), (4, 9001, 8192, 809), (5, 1, 0, 1)]


def test_sentencepiece_query(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q.op10_sentencepiece(spark, SF).collect():
        ids = None if texts[r.doc_id] is None else library.encode(texts[r.doc_id])
        want = (None,) * 4 if ids is None else (len(ids), zlib.crc32(" ".join(map(str, ids)).encode()), zlib.crc32(texts[r.doc_id].encode()), len(texts[r.doc_id]))
        assert (r.n_ids if ids is not None else None, r.ids_crc32 if ids is not None else None, r.text_crc32, r.text_chars) == want


def test_pipeline(spark, docs):
    """run() against the stages in plain Python: letters, equal texts, near-duplicates, pseudonyms, pieces."""
    texts = {r.doc_id: r.text for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    last = {lower(t): i for i, t in sorted(texts.items())}
    texts = {i: texts[i] for i in last.values()}
    comp, _ = brute_components(sorted(texts.items()), 5, 80)
    texts = {i: without_pii(t)[0] for i, t in texts.items() if comp[i] == i}
    check_packed(corpus_pipeline.run(spark, SF).toPandas(), texts)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns and now.count(), name
    assert {r.doc_id: r.text for r in now.collect()} == texts and now.where("n_chars <> length(text)").count() == 0


def test_pipeline_rows(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    a, b, c, d = (" ".join(p + w for w in words) for p in ("a", "b", "c", "d"))
    near = a + " more"
    rows = [(None, d), (None, c), (1, c), (2, "x y z"), (2, "x y z"), (None, "lone"), (None, "lone"), (3, near), (5, a), (5, b), (6, None), (7, "")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = corpus_pipeline.exact(spark, table, SF)
    assert told(kept) == sorted([(None, d), (1, c), (2, "x y z"), (None, "lone"), (3, near), (5, a), (5, b), (7, "")], key=str)
    want = sorted([(None, d), (1, c), (2, "x y z"), (None, "lone"), (3, near), (5, b), (7, "")], key=str)
    assert told(corpus_pipeline.near(spark, kept, SF)) == want
    # repeated rows and rows without an id fold in near alone too
    assert [r for r in told(corpus_pipeline.near(spark, table, SF)) if r[1]] == [r for r in want if r[1]]
