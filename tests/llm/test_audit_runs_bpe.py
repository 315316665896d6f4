"""Filter audit, periodic runs and byte-level BPE against brute-force versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from gatewright.llm import byte_bpe, filter_audit, periodic_runs, queries
from gatewright.llm.periodic_runs import RunOptions

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# filter audit


def plain_audit(rows, labels):
    """Every order and step, by going through the documents anew for each."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = collections.defaultdict(list)
    for i, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = ""
        if len(words) < 200:
            fails += "A"
        if 100 * len(set(words)) < 50 * len(words):
            fails += "B"
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails += "C"
        if re.search(r"[#$%&*|]", text):
            fails += "D"
        if i is not None and i > least[text]:
            fails += "E"
        parts[source or ""].append((i, fails))
    out = set()
    for part, documents in parts.items():
        shapley, found = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = documents
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in documents if f in d[1]]
                shapley[f] += len(removed)
                alone = sum(d[1] == f for d in failing)
                found.append((part, "".join(order), step, len(left), len(removed), len(failing) - len(removed), alone, sum(d[0] in good for d in removed), sum(d[0] in bad for d in removed), f))
        out |= {(*r[:-1], shapley[r[-1]]) for r in found}
    return out


def audited(spark, rows, labels, options=filter_audit.AuditOptions(), tasks=3):
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, part int, mask string").repartition(tasks)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, said, options).collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


def audit_rows():
    rng = random.Random(11)
    names = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(names) for _ in range(n))
    texts = [None, "", " \t\n", "one", "A B C", prose(199), prose(200), prose(260) + " #", "x " * 400, prose(300).upper(), prose(5000), "naïve ß 𝔘 " + prose(250)]
    rows = [(rng.randrange(200), rng.choice(texts), rng.choice(["a", "a", "a", "b", "", None])) for _ in range(400)]
    rows += [(1000 + i, texts[6], "a") for i in range(300)]  # a group of copies
    rows += [(7, texts[6], "b")] * 5 + [(-3, texts[6], "c"), (None, texts[6], "a"), (None, None, None)] * 2
    return rows, [(i, i % 3 == 0, i % 7 == 0) for i in range(0, 1200, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (9, None, None)]


def test_audit_against_plain_version(spark):
    rows, labels = audit_rows()
    labels = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels]
    want = plain_audit(rows, labels)
    assert audited(spark, rows, labels) == want
    # blocks of few bytes: copies are settled by the routed chains alone
    assert audited(spark, rows, labels, filter_audit.AuditOptions(block_bytes=1), 5) == want
    assert audited(spark, rows, []) == plain_audit(rows, [])


def test_audit_without_rows(spark):
    assert audited(spark, [], [(1, 1, 1)]) == set()


def test_colliding_fingerprints_stay_apart():
    chains = filter_audit.Chains()
    late = lambda text, i: chains.add(5, text, [(i, "p", 0, 1)])
    assert late(b"one", 4) == [] and late(b"two", 2) == []
    assert late(b"one", 9) == [(9, "p", 0, 1)] and late(b"one", 1) == [(4, "p", 0, 1)]
    assert late(b"two", 2) == [] and late(b"two", 3) == [(3, "p", 0, 1)]
    assert sorted(chains.texts()) == [(5, b"one", [(1, "p", 0, 1)]), (5, b"two", [(2, "p", 0, 2)])]


def test_non_minimum_ids(spark):
    rows, _ = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    least, want = {}, collections.Counter()
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _ in rows:
        if i is not None and i > least[t or ""]:
            want[i] += 1
    assert {r["doc_id"]: r["n"] for r in filter_audit.non_minimum_ids(docs).collect()} == want


# periodic runs


def plain_runs(word, options=RunOptions()):
    """Every period tried at every place."""
    found = {}
    for p in range(1, len(word) // options.least_exponent + 1):
        i = 0
        while i + p < len(word):
            if word[i] != word[i + p]:
                i += 1
                continue
            b = i
            while i + p < len(word) and word[i] == word[i + p]:
                i += 1
            if i + p - b >= max(options.least_length, options.least_exponent * p):
                found.setdefault((b, i + p), p)
    return sorted((b, e, p) for (b, e), p in found.items())


def random_word(rng):
    n, letters = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5])
    word = [rng.randrange(letters) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        s, p = rng.randrange(n - 1), rng.randint(1, 9)
        part = word[s : s + p]
        word = word[:s] + [part[i % len(part)] for i in range(n - s)]
        if rng.random() < 0.5:
            word = word + word[rng.randrange(len(word)) :] + [9] + word
    return word


@pytest.mark.parametrize("options", [RunOptions(), RunOptions(1, 2), RunOptions(2, 2), RunOptions(3, 3), RunOptions(10, 5), RunOptions(7, 4)])
def test_runs_of_random_words(options):
    rng = random.Random(options.least_length * 10 + options.least_exponent)
    for _ in range(1500):
        word = random_word(rng)
        want = plain_runs(word, options)
        assert periodic_runs.runs(word, options) == want, word
        assert periodic_runs.runs_of([b"%d" % c for c in word], options) == want, word


def test_factors_are_the_longest_that_begin_earlier():
    rng = random.Random(4)
    for _ in range(300):
        word = random_word(rng)
        at = 0
        for start, end, source in periodic_runs.factors(word):
            assert start == at
            longest = max((next(k for k in range(len(word) - start + 1) if start + k == len(word) or word[j + k] != word[start + k]) for j in range(start)), default=0)
            assert end - start == max(longest, 1) and (source >= 0) == (longest > 0)
            assert source < 0 or word[source : source + end - start] == word[start:end]
            at = end
        assert at == len(word)


def test_long_and_periodic_words_take_little_time():
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    assert all(e - s >= 3 * p for s, e, p in periodic_runs.runs(b, RunOptions(6, 3)))
    assert periodic_runs.runs([i % 20_000 for i in range(90_000)]) == [(0, 90_000, 20_000)]
    assert periodic_runs.runs([3] * 100_000) == [(0, 100_000, 1)]


def plain_op12(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(((b, e - b, p) for b, e, p in plain_runs(words)), key=lambda r: (r[0], r[2]))
    gone = {i for b, n, p in found for i in range(b + p, b + n)}
    from fractions import Fraction

    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return len(found), *best, milli, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


OP12 = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op12_against_plain_version(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in OP12) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert got == {i: plain_op12(i, t) for i, t in texts.items()}
    assert sum(g[0] > 0 for g in got.values()) > 3


def test_op12_on_awkward_rows(spark, tmp_path):
    rows = [(None, "a " * 50), (None, None), (1, None), (2, ""), (3, " \n\t"), (4, "x y " * 4), (5, "x y " * 3 + "x"), (6, "ß ß ß ß ß ß"), (6, "ß ß ß ß ß ß"), (7, "\x1c a b " * 9), (8, "k " * 5)]
    rows += [(i, " ".join(f"v{k % 13}" for k in range(i))) for i in range(10, 400, 3)]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, runs int, longest string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r["doc_id"], *(r[c] for c in OP12)) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect())
    assert got == collections.Counter((i, *plain_op12(i, t)) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def multilingual():
    import public_tokenizers

    return byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_on_every_character(multilingual, tiktoken_encoding):
    """All characters beside letters, in few long texts of their own, so every class and merge across it is seen."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a" for c in chars[i : i + 5000]) for i in range(0, len(chars), 5000)]
    assert multilingual.encode(texts) == [tiktoken_encoding.encode_ordinary(t) for t in texts]


def test_bpe_on_random_and_long_texts(multilingual, tiktoken_encoding):
    rng = random.Random(2)
    letters = [*" \t\n\r 　aAbé1٣!'sd日本語ไทย🙂‍\x00\x1c\x85", *map(chr, rng.sample(sorted(multilingual.masks), 20))]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 50_000 + "x", "日本" * 20_000, "\n" * 10_000, "<|endoftext|> it's", "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(30_000))]
    got = multilingual.encode(texts)
    assert got == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    assert [multilingual.decode(i).decode() for i in got] == texts
    assert max(map(len, multilingual.known)) <= byte_bpe.KEPT_LENGTH


def test_op13_against_tiktoken(spark, tiktoken_encoding):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op13_byte_bpe(spark, SF).collect()}
    ids = {i: tiktoken_encoding.encode_ordinary(t) for i, t in texts.items()}
    assert got == {i: (len(ids[i]), sha(",".join(map(str, ids[i]))), sha(t)) for i, t in texts.items()}


def test_bpe_on_awkward_rows(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "twice"), (3, "twice"), (4, "é" * 100_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, decoded int")
    got = collections.Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in byte_bpe.round_trip(df).collect())
    assert got == collections.Counter((i, t or "") for i, t in rows)
    assert byte_bpe.round_trip(df.limit(0)).count() == 0


def test_encoding_and_decoding_apart(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "twice twice"), (3, "twice twice"), (4, "日本 é\x00")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    ids = byte_bpe.encode(df)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == collections.Counter((r["doc_id"], tuple(r["ids"])) for r in byte_bpe.round_trip(df).collect())
    assert collections.Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in byte_bpe.decode(ids).collect()) == collections.Counter((i, t or "") for i, t in rows)
    first = byte_bpe.decode(ids.where("doc_id = 4").selectExpr("doc_id", "slice(ids, 1, 1) AS ids")).first()["decoded"]
    assert "日本".encode().startswith(bytes(first)) and byte_bpe.decode(spark.sql("SELECT 1 AS doc_id, CAST(NULL AS array<int>) AS ids")).first()["decoded"] == b""
    for wrong in (-1, 10**6):
        with pytest.raises(Exception, match="IndexError"):
            byte_bpe.decode(spark.sql(f"SELECT 1 AS doc_id, array({wrong}) AS ids")).collect()


def test_rank_files_with_gaps_are_refused(tmp_path):
    import base64

    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(255)))
    with pytest.raises(ValueError):
        byte_bpe.serialized(byte_bpe.read_ranks(str(path)))
    path.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path))
