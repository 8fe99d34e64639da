"""Each text operator against brute force, an exact round trip or held-out accuracy on small tables with awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from chronopanel.llm import bpe, common, langid, lm, packing, quantised, radix, secrets, simhash, urlfilter, warc
from chronopanel.llm.common import components, spanning
from chronopanel.session import scratch_path

DOCS = "doc_id long, text string, lang string, row long, n long, key string"


def table(spark, texts, schema=DOCS, ids=None):
    """Documents with extra columns whose names clash with those inside the operators."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", 7, 8, "x") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


def words(seed, n, size=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(r.choice([n, size])))


AWKWARD = [
    None, "", " ", "\n\t ", "a", "a  b", "a b", "a\tb", "é" * 40, "x" * 30_000, "same text " * 900, "same text " * 900, "same text " * 899 + "other text",
    "日本語のテキスト 12", " x ", "it's  'll  ", "a" * 200 + " ", "<|endoftext|>", "🙂 🙂  🙂",
]


def test_spanning_and_components(spark):
    r = np.random.default_rng(1)
    u, v = r.integers(0, 300, 250), r.integers(0, 300, 250)
    root = list(range(300))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in zip(u, v):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in {*u.tolist(), *v.tolist()} if (find(i) != i or any(find(j) == i for j in {*u.tolist(), *v.tolist()} if j != i))}
    m, s = spanning(300, u, v)
    assert all(find(a) == b for a, b in zip(m.tolist(), s.tolist())) and len(m) == len(want) - len(set(want.values()))
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(u, v)] + [(5, None), (None, None)], "u long, v long")
    assert {r.node: r.component for r in components(edges).collect()} == want
    assert components(edges.limit(0)).count() == 0
    chain = spark.range(400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in components(chain).collect()} == {0}


# --- archives -----------------------------------------------------------------------------


def test_archive_round_trip(spark):
    big = "<p>" + "payload é 🙂\r\n\r\nWARC/1.1\r\n" * 40
    html = {1: "short", 2: "short", 3: big, 4: big, 5: None, 6: "", 7: big + "x", 8: "y" * 200_000, 9: big}
    pages = spark.createDataFrame([(k, f"http://h.org/{k} a\r\nb" if k != 7 else None, v, "clash") for k, v in html.items()], "page_id long, url string, html string, kind string")
    got = {int(r.record_id.split(":")[2]): r for r in warc.transactions(pages, scratch_path(spark, "w")).collect()}
    assert set(got) == set(html)
    for k, v in html.items():
        raw = (v or "").encode()
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        if k in (4, 9):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", "<urn:capture:3:response>", None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
        assert len(r.requests) == len(r.metadata) == 1
        assert r.target_uri == (None if k == 7 else f"http://h.org/{k}%20a%20%20b".replace("%20a%20%20b", "%20a%20%20b"))


def test_archive_of_repeated_and_no_pages(spark):
    schema = "page_id long, url string, html string"
    twice = spark.createDataFrame([(1, "u", "z" * 150), (1, "u", "z" * 150), (None, "u", "z" * 150)], schema)
    assert warc.transactions(twice, scratch_path(spark, "w")).count() == 3
    assert warc.transactions(twice.limit(0), scratch_path(spark, "w")).count() == 0


def test_archive_of_awkward_ids(spark):
    """Ids that hold line breaks, colons or nothing come back as they are; a null id stays null and refers to the others."""
    ids = ["a", "b\r\nWARC-Type: x", "c:response>", "", None, "d é%20+", "null"]
    pages = spark.createDataFrame([(i, "u", "z" * 150 if i in ("a", None) else i) for i in ids], "page_id string, url string, html string")
    out = warc.transactions(pages, scratch_path(spark, "w"))
    got = out.select(warc.page_of(F.col("record_id"), "string").alias("id"), "record_type", warc.page_of(F.col("refers_to"), "string").alias("to")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, "revisit" if i is None else "response", "a" if i is None else None) for i in ids], key=str)
    alone = spark.createDataFrame([(None, "u", "z" * 150), (None, "u", "z" * 150)], "page_id long, url string, html string")
    assert [r.record_type for r in warc.transactions(alone, scratch_path(spark, "w")).collect()] == ["response", "response"]


def test_assembly_follows_every_direction(spark):
    kinds = [
        ("r1", "response", []), ("q1", "request", ["r1"]), ("m1", "metadata", ["q1"]),  # by way of the request
        ("r2", "response", ["q2"]), ("q2", "request", []), ("r3", "revisit", []), ("m9", "metadata", ["lost"]),
    ]
    found = spark.createDataFrame([(i, k, c, None, None, None, 1, None, None) for i, k, c in kinds], warc.RECORD)
    got = {r.record_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.assemble(found).collect()}
    assert got == {"r1": (["q1"], ["m1"]), "r2": (["q2"], []), "r3": ([], [])}


# --- exact duplicates ---------------------------------------------------------------------


def test_radix_groups(spark):
    long = "p" * (radix.DIGIT * radix.GROWTH + radix.DIGIT)
    texts = [*AWKWARD, long + "a", long + "b", long + "a", "q" * 64, "q" * 64, "q" * 65, "q" * 63 + "r", *["copy of many"] * 200]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    got = {r.doc_id: r for r in radix.duplicates(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (ids[0], len(ids), i == ids[0])
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    kept = radix.without_duplicates(table(spark, texts))
    assert kept.columns == table(spark, texts[:1]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(ids[0] for ids in groups.values())


def test_radix_repeated_and_null_ids(spark):
    df = table(spark, ["a", "a", "b", "a", "c", "c"], ids=[5, 5, 5, 9, None, None])
    rows = radix.duplicates(df).collect()
    assert sorted((r.text_sha256, r.kept) for r in rows).count((hashlib.sha256(b"a").hexdigest(), True)) == 1
    assert sum(r.kept for r in rows) == 3
    assert sorted(r.text for r in radix.without_duplicates(df).collect()) == ["a", "b", "c"]
    assert radix.duplicates(df.limit(0)).count() == 0 and radix.without_duplicates(df.limit(0)).count() == 0


# --- tokens -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def many():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_replayed_ids_are_those_of_the_library(spark, many):
    path, library = many
    r = random.Random(3)
    texts = AWKWARD + ["".join(r.choice("abcdeéß \n'.123") for _ in range(r.randint(0, 300))) for _ in range(150)] + ["ab" * 3000 + " x"]
    docs = table(spark, texts)
    got = {x.doc_id: x for x in bpe.coded(docs, path, public_tokenizers.PATTERN, with_ids=True, slice_bytes=2000).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert bytes(got[i].decoded).decode() == (t or "")
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decoded(spark.createDataFrame([(1, got[13].ids), (2, None)], "doc_id long, ids array<int>"), path)
    assert {x.doc_id: bytes(x.text).decode() for x in back.collect()} == {1: texts[13], 2: ""}
    assert bpe.coded(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["x" * 1_000_000, "".join(random.Random(2).choice("acgt") for _ in range(1_000_000)), " " * 300_000, "a" + " " * 300_000 + "b" + " \n" * 100_000, " " * 5_000_000])
def test_very_long_words(many, text):
    """A word of a megabyte and runs of millions of spaces cost seconds, not the square of their length."""
    import time

    path, library = many
    start = time.perf_counter()
    ids = bpe.encode([text], bpe.load(path), bpe.regex.compile(public_tokenizers.PATTERN))[0]
    assert time.perf_counter() - start < 60
    if len(text) > 1_000_000:  # beyond the library's own limits: a run of spaces is its longest token over and over
        tokens = [bpe.load(path).bytes_of[i] for i in ids.tolist()]
        assert b"".join(tokens) == text.encode() and len(set(tokens[:-9])) == 1
    else:
        assert ids.tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 5_000_000, "a" + " " * 300_000 + "b", "y" * 300_000])
def test_packing_of_very_long_runs(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = packing.tokenizer(path)
    assert next(iter(model.documents([text]))).tolist() == model.model.encode(text, add_special_tokens=False).ids


def test_words_of_few_letters_against_one_merge_at_a_time():
    """Overlapping places, adjacent merges and merges that form lower ranks, over random rank tables."""
    r = random.Random(11)
    for _ in range(60):
        tokens = {bytes([b]): b for b in range(256)}
        pool = [b"a", b"b", b"c"]
        for rank in r.sample(range(256, 400), 14):
            new = r.choice(pool) + r.choice(pool)
            if new not in tokens:
                tokens[new] = rank
                pool.append(new)
        merges = bpe.Merges(tokens)
        made = ["".join(r.choice("abc") for _ in range(r.randint(1, 40))).encode() for _ in range(60)] + [b"a" * 37, b"ab" * 30]
        made = [w for w in made if w not in tokens]
        ids = bpe.replay(made, merges)
        for i, w in enumerate(made):
            parts = [bytes([b]) for b in w]
            while options := [(tokens[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in tokens]:
                k = min(options)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert ids.gather(np.array([i])).tolist() == [tokens[p] for p in parts]


def test_a_merge_may_form_a_pair_of_lower_rank():
    """Ranks where ab comes after abc: the pair (ab, c) has to go before the next ab of the same word."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 400, b"abca": 310, b"bb": 350}
    merges = bpe.Merges(ranks)

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not options:
                return [ranks[p] for p in parts]
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(5)
    words_ = ["".join(r.choice("abc") for _ in range(r.randint(1, 12))).encode() for _ in range(500)]
    words_ = [w for w in words_ if w not in ranks]
    ids = bpe.replay(words_, merges)
    assert [ids.gather(np.array([i])).tolist() for i in range(len(words_))] == [plain(w) for w in words_]
    assert base64.b64decode(b"YQ==") == b"a" and len(bpe.replay([], merges).flat) == 0


# --- languages ----------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    r = random.Random(2)
    syllables = {"en": ["th", "er", "ing", "wh", "ou"], "fr": ["eau", "é", "que", "oi", "le"], "de": ["sch", "ü", "ein", "ung", "z"]}
    make = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(lang, 1 + i % 40), lang, i) for i, lang in enumerate(r.choice(list(syllables)) for _ in range(300))]
    rows += [(1000, None, "en", 0), (1001, "123 !", "fr", 0), (1002, "", None, 0), (1003, make("de", 20_000), None, 0), (None, make("fr", 50), None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").repartition(4)
    known = langid.learned(docs)
    assert sorted(known) == ["de", "en", "fr"] and all(len(v) <= langid.PROFILE for v in known.values())
    got = {x.doc_id: x for x in langid.predicted(docs, known).collect()}
    assert len(got) == len(rows)
    held = [x for x in rows[:300] if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    marks = {x.doc_id: x.h for x in docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(marks[x[0]] == (zlib.crc32(str(x[0]).encode()) % 3 == 1) for x in rows[:300])
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "de", "fr"]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in langid.predicted(docs, {}).collect()} == {"und"}
    assert langid.predicted(docs.limit(0), known).count() == 0 and langid.learned(docs.limit(0)) == {}


def test_profile_counts_every_gram(spark):
    texts = ["Aba ab", "ba", "ab-ba"]
    grams = defaultdict(int)
    for t in texts:
        for w in re.findall("[a-z]+", t.lower()):
            w = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] != " ":
                        grams[w[i : i + n]] += 1
    code = lambda g: sum(ord(c) << 21 * (2 - i) for i, c in enumerate(g))
    want = [code(g) for g in sorted(grams, key=lambda g: (-grams[g], code(g)))]
    docs = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")
    assert langid.profiles(docs)["xx"].tolist() == want


def gram_order(texts):
    """Codes of all n-grams of the words of some texts, most frequent first, equally frequent ones by code."""
    counts = defaultdict(int)
    for unit in " ".join(texts).split():
        for word in bpe.regex.findall(r"\p{L}+", unit.lower()):
            padded = f" {word} "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    if padded[i : i + n] != " ":
                        counts[sum(ord(c) << 21 * (2 - k) for k, c in enumerate(padded[i : i + n]))] += 1
    return sorted(counts, key=lambda g: (-counts[g], g))


def test_distances_are_out_of_place(spark):
    """Language and score of every text against ranks compared one by one; languages with one profile tie, the first name wins."""
    r = random.Random(8)
    letters = {"bb": "abcdeé", "aa": "abcdeé", "zz": "cdefgh", "mm": "eéxyzß"}
    make = lambda lang, n: " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(1, 5))) for _ in range(n))
    twin = make("bb", 200)
    learned = [("bb", twin), ("aa", twin), ("zz", make("zz", 300)), ("mm", make("mm", 250)), ("zz", make("zz", 10)), (None, "qqq"), ("mm", None)]
    known = langid.profiles(spark.createDataFrame([(lang, t) for lang, t in learned], "lang string, text string"))
    orders = {lang: gram_order([t for other, t in learned if other == lang and t])[: langid.PROFILE] for lang in letters}
    assert {lang: v.tolist() for lang, v in known.items()} == orders
    texts = [make(r.choice(list(letters)), r.randint(1, 60)) for _ in range(80)] + ["", None, "12 !", "É é", "ẞ ŉ İ", "a", "a a a", "日本 語", "q" * 5000, make("zz", 3000), twin]
    got = {x.doc_id: x for x in langid.predicted(table(spark, texts), known).collect()}
    ties = 0
    for i, t in enumerate(texts):
        order = gram_order([t or ""])[: langid.PROFILE]
        if not order:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        distance = {lang: sum(abs(n - orders[lang].index(g)) if g in orders[lang] else langid.PROFILE for n, g in enumerate(order)) for lang in letters}
        best = min(sorted(distance), key=distance.get)
        ties += distance["aa"] == distance["bb"] == distance[best]
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 - distance[best] / (langid.PROFILE * len(order)), abs=1e-12)
    assert ties > 10


# --- URL filters --------------------------------------------------------------------------


def test_lists_as_of_the_fetch(spark):
    r = random.Random(4)
    hosts = ["a.x.org", "x.org", "b.x.org", "y.net", "deep.a.x.org"]
    entries = [
        (r.choice("LM"), r.choice([*hosts, "org", "y.net/f/"]), f"2024-01-{r.randint(1, 28):02d}", r.random() < 0.6, r.randint(0, 3)) for _ in range(60)
    ] + [("L", None, "2024-01-01", True, 1), ("L", "x.org", None, True, 1)]
    urls = [f"https://u@{h.upper()}:80/{p}" for h in hosts for p in ("", "f/p?q", "g/")] + [None, "mailto:x", "http:///p", ""]
    captures = [(i, r.choice(urls), f"2024-01-{r.randint(1, 31):02d}" if i % 17 else None) for i in range(300)] + [(3, urls[0], "2024-01-20")]
    e = spark.createDataFrame(entries, "list string, pattern string, day string, added boolean, seq long").withColumn("day", F.to_date("day"))
    c = spark.createDataFrame([(*x, "clash") for x in captures], "page_id long, url string, day string, pattern string").withColumn("day", F.to_date("day"))
    latest = {}
    for lst, pat, day, added, seq in entries:
        if pat and day:
            latest[lst, pat, day] = max(latest.get((lst, pat, day), (-1, False)), (seq, added))

    def active(lst, pat, day):
        before = [(d, v[1]) for (l, p, d), v in latest.items() if (l, p) == (lst, pat) and d <= day]
        return bool(before) and max(before)[1]

    want = []
    for i, url, day in captures:
        m = re.match(r"[A-Za-z]+://([^/?#]*)", url or "")
        host = re.sub(":[0-9]*$", "", re.sub("^.*@", "", m[1])).lower() if m else ""
        keys = set()
        if host and day:
            parts = host.split(".")
            keys = {".".join(parts[k:]) for k in range(len(parts))}
            f = re.match(r"[A-Za-z]+://[^/?#]*/([^/?#]+)/", url)
            keys |= {f"{host}/{f[1]}/"} if f else set()
        hit = [(p, lst) for p in keys for lst in "LM" if active(lst, p, day)]
        want.append((i, host or None, len(hit), bool(hit), min((p for p, _ in hit), default=None)))
    got = [(x.id, x.host, x.n_active, x.blocked, x.first_pattern) for x in urlfilter.evaluated(c, e).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not any(x.blocked for x in urlfilter.evaluated(c, e.limit(0)).collect()) and urlfilter.evaluated(c.limit(0), e).count() == 0
    plan = urlfilter.evaluated(c, e)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("PythonRDD", "")


# --- embeddings ---------------------------------------------------------------------------


def test_every_near_vector_is_linked(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(60, 24))
    x = np.concatenate([base[r.integers(0, 60, 500)] + r.normal(size=(500, 24)) * r.choice([0.05, 0.2, 0.4], size=(500, 1)), np.repeat(base[:1], 90, axis=0)])
    x = x.astype(np.float32)
    label = r.integers(0, 3, len(x))
    rows = [(i, [float(c) for c in v], int(k), 5) for i, (v, k) in enumerate(zip(x, label))]
    odd = [(900, None, 1, 5), (901, [0.0] * 24, 1, 5), (902, [float("nan")] * 24, 1, 5), (903, [None] * 24, 1, 5), (904, [1.0] * 24, None, 5), (905, [1.0], 1, 5), (906, [float("inf")] * 24, 1, 5)]
    schema = "vec_id long, embedding array<float>, label int, key long"
    df = spark.createDataFrame(rows + odd, schema).repartition(5)
    got = {g.vec_id: g for g in quantised.near_vectors(df, 0.93).collect()}
    assert len(got) == len(rows) + len(odd)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        low = np.array([min(comp[i], comp[near[i]].min(initial=len(x))) for i in range(len(x))])
        if (low == comp).all():
            break
        comp = low
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), comp[i], comp[i] == i)
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k, *_ in odd)
    assert quantised.near_vectors(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0, 5), (1, [1.0, 0.0], 0, 5)], schema)
    assert [(g.n_links, g.component_id) for g in quantised.near_vectors(twice).collect()] == [(1, 1), (1, 1)]


def test_vectors_of_every_length_are_linked(spark):
    r = np.random.default_rng(4)
    rows, want = [], {}
    for dims in (8, 24, 5):
        x = (r.normal(size=(10, dims))[r.integers(0, 10, 60)] + r.normal(size=(60, dims)) * 0.05).astype(np.float32)
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        near = u @ u.T >= 0.93
        np.fill_diagonal(near, False)
        comp = np.arange(60)
        while ((low := np.array([min(comp[i], comp[near[i]].min(initial=60)) for i in range(60)])) != comp).any():
            comp = low
        at = len(rows)
        want |= {at + i: (near[i].sum(), at + comp[i], comp[i] == i) for i in range(60)}
        rows += [(at + i, [float(c) for c in v], 1, 5) for i, v in enumerate(x)]
    got = quantised.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key long").repartition(3), 0.93)
    assert {g.vec_id: (g.n_links, g.component_id, g.kept) for g in got.collect()} == want and all(any(want[k][0] for k in range(s, s + 60)) for s in (0, 60, 120))


def test_tiles_of_vectors_meet_without_being_dealt_out(spark, monkeypatch):
    """Many tiles of a label, labels of one tile, copies, ids that repeat or are null: every link, and no pair of tiles is shuffled."""
    monkeypatch.setattr(quantised, "TILE", 16)
    kept, plans = quantised.stored, {}

    def stored(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, label)

    monkeypatch.setattr(quantised, "stored", stored)
    r = np.random.default_rng(8)
    x = (r.normal(size=(12, 24))[r.integers(0, 12, 300)] + r.normal(size=(300, 24)) * r.choice([0.05, 0.3, 2], size=(300, 1))).astype(np.float32)
    x[280:] = x[r.integers(0, 20, 20)]
    label = np.array(["a"] * 200 + ["b"] * 60 + ["c"] * 5 + ["d"] * 2 + ["a"] * 33)
    ids = [None if i % 50 == 7 else i - i % 2 for i in range(300)]
    rows = [(k, [float(c) for c in v], str(w)) for k, v, w in zip(ids, x, label)]
    rows.append((1000, [-float(c) for c in x[0]], "a"))
    got = quantised.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(4), 0.93)
    u = np.array([v for _, v, _ in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.append(label, "a")
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = np.arange(301)
    while ((low := np.array([min(comp[i], comp[near[i]].min(initial=301)) for i in range(301)])) != comp).any():
        comp = low
    lowest = {k: min((i for (i, *_), at in zip(rows, comp) if at == k and i is not None), default=None) for k in comp}
    want = [(i, int(n), lowest[k], i == lowest[k]) for (i, *_), n, k in zip(rows, near.sum(axis=1), comp)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and near.sum() > 1000
    assert "Exchange" not in plans["found"]


def test_no_vectors_are_broadcast_and_few_sent_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(quantised, "SAMPLE", 64)
    plans, ordered, write, limit = [], [], quantised.stored, DataFrame.limit

    def stored(df, label="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    def limited(df, n):
        ordered.append(df.count())
        return limit(df, n)

    monkeypatch.setattr(quantised, "stored", stored)
    monkeypatch.setattr(common, "stored", stored)
    monkeypatch.setattr(DataFrame, "limit", limited)
    x = np.random.default_rng(9).normal(size=(2000, 16))
    x[::50] = x[0] + x[::50] / 20
    df = spark.createDataFrame([(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = quantised.near_vectors(df.repartition(8), 0.93)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    # each task keeps as many rows for the sample as the sample has
    assert 64 <= max(ordered) <= 3 * 64
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
    assert out.filter("n_links > 0").count() == 40


# --- SimHash ------------------------------------------------------------------------------


def plain_print(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    r = random.Random(6)
    texts = list(AWKWARD) + [" ", "É a b c D"]
    for s in range(25):
        base = words(s, 120, 200).split()
        texts += [" ".join(base)] * 3
        for _ in range(4):
            copy = list(base)
            copy[r.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    prints = [plain_print(t, 4) for t in texts]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {x.doc_id: x for x in simhash.near_duplicates(table(spark, texts), 4, 4).collect()}
    assert [got[i].fp % 2**64 for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    kept = simhash.one_of_each(table(spark, texts), 4, 4)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({find(i) for i in range(len(texts))}) and kept.columns == table(spark, ["a"]).columns
    assert simhash.near_duplicates(table(spark, texts).limit(0)).count() == 0
    odd = simhash.near_duplicates(table(spark, ["a b", "a b", None, ""], ids=[7, 7, None, None]), 4, 4).collect()
    assert sorted((str(x.doc_id), str(x.component_id)) for x in odd) == [("7", "7"), ("7", "7"), ("None", "None"), ("None", "None")]


def test_one_document_of_each_group_where_ids_repeat(spark):
    near = words(1, 120, 200)
    copy = near.split()
    copy[60] = "changed"
    far, third = words(2, 120, 200), words(3, 120, 200)
    texts = [near, " ".join(copy), far, near, third, third, far + " end", near]
    ids = [7, 7, 7, None, None, None, 9, 8]
    prints = [plain_print(t, 4) for t in texts]
    group = [min(j for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 8) for i in range(len(texts))]
    assert sorted(set(group)) == [0, 2, 4]
    kept = simhash.one_of_each(table(spark, texts, ids=ids), 4, 8)
    rows = [(x.doc_id, x.text) for x in kept.collect()]
    assert sorted(group[texts.index(t)] for _, t in rows) == [0, 2, 4]
    assert sorted(str(i) for i, _ in rows) == ["7", "7", "None"] and set(rows) <= set(zip(ids, texts))


def test_tiles_miss_no_pair(spark):
    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 300, dtype=np.int64)
    flips = base[r.integers(0, 300, 900)] ^ (np.int64(1) << r.integers(0, 64, 900)) ^ (np.int64(1) << r.integers(0, 64, 900)) ^ (np.int64(1) << r.integers(0, 64, 900))
    fp = np.unique(np.concatenate([base, flips, [0, -1]]))
    bits = fp.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    m, s = spanning(len(fp), *np.nonzero(near))
    want = dict(zip(fp[m].tolist(), fp[s].tolist()))
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    got = defaultdict(set)
    for x in components(simhash.linked(df, 4)).collect():
        got[x.component].add(x.node)
    groups = defaultdict(set)
    for k, v in want.items():
        groups[v] |= {k, v}
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


# --- secrets ------------------------------------------------------------------------------


def plain_base(text):
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [("assign", m.start(), m.end())] if len(m[2]) >= 6 else []
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


KEY = "q7Zx9LmR2vKp4TnW8sYb3HdF"
SECRETS = [
    "password=abc", 'PassWord" : \'hunter22 x', "token token=aaaaaa secret:bbbbbb", "AKIA" + "B" * 16, "AKIA" + "B" * 15, "xAKIAAKIA" + "9" * 20,
    "f" * 24, "f" * 23, "é🙂 api_key=abcdef apikey = 'zzzzzz'", "ſecret=abcdef toKen=abcdef", KEY, f"see {KEY} here", "password=" + KEY,
    "123e4567-e89b-12d3-a456-426614174000", "donaudampfschifffahrtsgesellschaftskapitaen", "0123456789abcdefABCDEF0123456789", "example" + KEY, "1" * 40, "password=   ",
]


def test_spans(spark):
    texts = SECRETS + AWKWARD
    got = {x.doc_id: x.spans for x in secrets.scanned(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind != "entropy"] == plain_base(t or "")
    dense = lambda t: [(s[1], s[2]) for s in secrets.spans(t) if s[0] == "entropy"]
    assert dense(KEY) == [(0, 24)] and dense(f"see {KEY} here") == [(4, 28)]
    assert not any(dense(t) for t in SECRETS[12:])
    assert secrets.scanned(table(spark, texts).limit(0)).count() == 0


def test_incremental_entropy():
    r = random.Random(9)
    for _ in range(200):
        s = "".join(r.choice("abc123XYZ/+") for _ in range(r.randint(0, 60)))
        covered = set()
        for i in range(len(s) - 23):
            w = s[i : i + 24]
            bits = -sum(w.count(c) / 24 * np.log2(w.count(c) / 24) for c in set(w))
            if bits >= 3.0 - 1e-9 and any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
                covered |= set(range(i, i + 24))
        assert {p for a, b in secrets.dense_runs(s, 3.0) for p in range(a, b)} == covered


def test_masks(spark):
    texts = ["clean", None, f"a password={KEY} b {KEY} AKIA{'B' * 16}."]
    out = {x.doc_id: x for x in secrets.redacted(table(spark, texts), "text", "n").collect()}
    assert (out[0].text, out[1].text) == ("clean", None) and out[2].text == "a password=[SECRET] b [SECRET] [SECRET]."
    assert (out[0].n, out[1].n, out[2].n) == (5, 8, len(out[2].text))


def plain_entropy(text):
    """Places in windows that share no character with an allowed match, begin right behind no allowed word and are dense; base
    spans are taken out."""
    covered = set()
    (uuid, _), (word, _) = secrets.ALLOWED
    for _, pattern, threshold in secrets.CLASSES:
        for c in pattern.finditer(text):
            for i in range(c.start(), c.end() - 23):
                w = text[i : i + 24]
                bits = -sum(w.count(x) / 24 * np.log2(w.count(x) / 24) for x in set(w))
                near = any(m.start() < i + 24 and i < m.end() for m in uuid.finditer(text)) or any(m.start() < i + 24 and i <= m.end() for m in word.finditer(text))
                if not near and bits >= threshold - 1e-9 and any(x.isdigit() for x in w) and any(x.isalpha() for x in w):
                    covered |= set(range(i, i + 24))
    return covered - {p for _, a, b in plain_base(text) for p in range(a, b)}


def test_secrets_glued_to_others(spark):
    uuid, ident = SECRETS[13], "0a1b2c3d4e5f60718293a4b5"
    for glued in (f"{KEY}-{ident}", f"{ident}_{KEY}", f"{KEY}/{ident}/{KEY}", f"{KEY}-token=aaaaaa", f"sample/{KEY}", f"{KEY}-0123456789", f"a/{uuid}/{KEY}", f"{uuid}{KEY}", f"x=example&key/{KEY}"):
        found = {p for k, a, b, _ in secrets.spans(glued) for p in range(a, b)}
        at = glued.index(KEY)
        assert set(range(at, at + 24)) <= found, glued
        assert KEY not in secrets.cleared(glued) and ident not in secrets.cleared(glued)
    r = random.Random(12)
    parts = [KEY, ident, uuid, "sample", "0123456789", "token=abcdef", "donaudampf", "/", "-", "_", " ", "=", "AKIA" + "B7" * 9, "0123ABCDef" * 3]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        entropy = [(a, b) for k, a, b, _ in secrets.spans(text) if k == "entropy"]
        assert {p for a, b in entropy for p in range(a, b)} == plain_entropy(text), text
        assert sum(b - a for a, b in entropy) == len(plain_entropy(text))


# --- language models ----------------------------------------------------------------------


def test_losses(spark):
    texts = [None, "", "abcab", "abc abc", "zzz", "é🙂", "abcab"] + [words(s, 5, 9) for s in range(30)]
    good = {2, 3, 7, 9, 11}
    docs = table(spark, texts).withColumn("target", F.col("doc_id").isin(*good))
    grams = {True: defaultdict(int), False: defaultdict(int)}
    for i, t in enumerate(texts):
        s = lm.BEFORE * 3 + (t or "")
        for k in range(3, len(s)):
            for side in (True, False):
                if not side or i in good:
                    for n in range(1, 5):
                        grams[side][s[k - n + 1 : k + 1]] += 1
                        grams[side]["ctx", s[k - n + 1 : k]] += 1
    letters = len({c for t in texts for c in t or ""})

    def p(side, g):
        low = p(side, g[1:]) if len(g) > 1 else 1 / letters
        return (grams[side][g] + lm.PRIOR * low) / (grams[side]["ctx", g[:-1]] + lm.PRIOR)

    got = {x.doc_id: x for x in lm.scored(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        assert got[i].n_tokens == len(t)
        if not t:
            assert got[i].score is None and got[i].loss_target is None
            continue
        s = lm.BEFORE * 3 + t
        loss = {side: -np.mean([np.log(p(side, s[k - 3 : k + 1])) for k in range(3, len(s))]) for side in (True, False)}
        assert np.allclose([got[i].loss_target, got[i].loss_background, got[i].score], [loss[True], loss[False], loss[True] - loss[False]])
    assert lm.scored(docs.limit(0)).count() == 0
    assert lm.scored(docs.withColumn("target", F.lit(None).cast("boolean"))).count() == len(texts)


# --- packing ------------------------------------------------------------------------------


def test_best_fit_is_the_tightest():
    r = random.Random(7)
    for _ in range(20):
        lengths = [r.randint(1, 64) for _ in range(r.randint(0, 80))]
        rooms, want = [], []
        for n in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [room for room in rooms if room >= lengths[n]]
            if fits:
                k = rooms.index(min(fits))
                rooms[k] -= lengths[n]
            else:
                rooms.append(64 - lengths[n])
            want = sorted(rooms)
        got = packing.best_fit(lengths, 64)
        assert sorted(64 - sum(lengths[i] for i in w) for w in got) == want
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))


def test_pieces(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = AWKWARD + [words(s, 30, 3000) for s in range(40)] + ["tail    x  "]
    texts += ["a <|endoftext|> b", "a  <|endoftext|>", "<|endoftext|><|endoftext|>  c d", "x y<|endoftext|>z\n<|endoftext|"]
    model = Tokenizer.from_file(path)
    want = {i: np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in enumerate(texts)}
    assert want[len(texts) - 4].tolist() == [64, 220, 50256, 275, 1]
    pieces = packing.packed(table(spark, texts), path, with_ids=True, slice_bytes=60_000).collect()
    seen, sequences = defaultdict(list), defaultdict(list)
    for x in pieces:
        ids = want[x.doc_id][x.start : x.start + x.length]
        assert x.length == len(ids) > 0 and x.ids == ids.tolist() and x.ids_crc32 == zlib.crc32(ids.tobytes()) and x.doc_tokens == len(want[x.doc_id])
        seen[x.doc_id].append((x.start, x.length))
        sequences[x.sequence_id].append((x.offset, x.length))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert packing.packed(table(spark, texts).limit(0), path).count() == 0
    model.encode_special_tokens = True
    ids = packing.packed(table(spark, ["a <|endoftext|> b"]), path, with_ids=True, literal=True).collect()
    assert [x for p in sorted(ids, key=lambda p: p.start) for x in p.ids] == model.encode("a <|endoftext|> b", add_special_tokens=False).ids + [1]
    nulls = packing.packed(table(spark, ["a", None, "b"], ids=[None, None, 3]), path).collect()
    assert {(x.doc_id, x.doc_tokens) for x in nulls} == {(None, 1), (None, 2), (3, 2)}
    again = packing.packed(table(spark, ["a", "a"], ids=[1, 1]), path).collect()
    assert sorted((x.start, x.length, x.doc_tokens) for x in again) == [(0, 2, 2), (0, 2, 2)]
