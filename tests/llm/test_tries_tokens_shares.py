"""Prefix tries, byte-level BPE and source divergence against brute force, on whole small tables and on awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, divergence, prefix_trie, queries

SF = "/root/testdata/sf0.001"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sha(data):
    return hashlib.sha256(data).hexdigest()


# 11 conversation prefix trie


def rebuilt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = sha(f"{len(role.encode())}:{role}{text}".encode())
        convs[conv].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(np.fmod(c, 20)), [])
        out[c] = base[:h] + turns[h:]
    return out


def trie_brute(rows):
    members = defaultdict(list)
    convs = rebuilt([r for r in rows if r[0] is not None])
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
            leaves[k[:d]] += kids[k] == 0
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(ends.encode())))
    return Counter(out)


def trie(df):
    return Counter(map(tuple, prefix_trie.prefix_trie(df).collect()))


CONV = "conv_id long, turn long, role string, text string"


def talks(seed, n=40, deep=6):
    """Conversations of few different turns, so that many share prefixes; negative ids, absent bases, nulls, ties."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 90), n):
        for t in range(rng.randrange(1, deep)):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b c\n", "", None, "é x", "x " * 30])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_of_random_talks(spark, seed):
    rows = talks(seed)
    assert trie(spark.createDataFrame(rows, CONV)) == trie_brute(rows)


def test_trie_where_a_task_sends_nodes_early(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FLUSH_NODES", 2)
    rows = talks(4)
    assert trie(spark.createDataFrame(rows, CONV)) == trie_brute(rows)


def test_trie_of_deep_copies_and_a_hot_prefix(spark):
    """Two long equal conversations, and one first turn that most others share: summed by doubling and hot-key joins."""
    long = [(c, t, "user", f"turn {t}") for c in (1000, 2000) for t in range(70)]
    hot = [(c, t, "system", "same words here" if t == 0 else f"{c % 7} {t}") for c in range(3000, 3200) for t in range(3)]
    rows = long + hot + [(5000, 0, "user", "x")] * 3
    assert trie(spark.createDataFrame(rows, CONV)) == trie_brute(rows)


def test_trie_of_the_table_and_of_nothing(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, queries.op11_prefix_trie(spark, SF).collect())) == trie_brute(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_trie_ignores_other_columns_and_rows_of_no_conversation(spark):
    rows = [*talks(5), (None, 0, "user", "nobody's")]
    df = spark.createDataFrame(rows, CONV).withColumns({"key": F.lit(1), "family": F.lit("f"), "words": F.lit(2)})
    assert trie(df) == trie_brute(rows)


# 12 byte-level BPE


def encoding():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", "\n\n \t x", "don't I'LL 'S", "a" * 5000, " " * 3000 + "b", "é ö 😀 日本語 한국어 ‍́", "<|endoftext|> <unk> ▁x", "\x00\x01\x1c\x85\xa0", "12345 6789", "x😀" * 2000, "\r\n\r\n"]


def test_bpe_is_the_library(spark):
    want = encoding()
    rng = random.Random(9)
    texts = TEXTS + ["".join(rng.choice("abe 'st.\n1é日́😀") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["".join(f"a{c}1{c} {c}." for c in map(chr, range(k, k + 97))) for k in range(0, 0xD000, 97)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.bpe_decode(byte_bpe.bpe_encode(df, MULTI, public_tokenizers.PATTERN), MULTI, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert list(np.frombuffer(got[k].ids, "<u4")) == want.encode_ordinary(t or "")
        assert bytes(got[k].decoded) == (t or "").encode()


def test_bpe_of_documents(spark):
    want = encoding()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, queries.op12_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    brute = []
    for r in docs.collect():
        ids = want.encode_ordinary(r.text or "")
        brute.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    assert got == sorted(brute)


def test_bpe_rows_and_columns(spark):
    df = spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (3, "a b", 2)], "doc_id long, text string, ids int")
    got = byte_bpe.bpe_encode(df, MULTI, public_tokenizers.PATTERN).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "None"] and len({bytes(r.ids) for r in got}) == 1
    assert byte_bpe.bpe_encode(df.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0
    again = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert [(r.doc_id, r.decoded) for r in byte_bpe.bpe_decode(again, MULTI, public_tokenizers.PATTERN).orderBy("doc_id").collect()] == [(1, None), (2, bytearray())]


def test_bpe_looks_up_what_merges_do_not_rebuild(tmp_path):
    """'abc' has no pair of parts that are tokens, yet a pre-token 'abc' is that token."""
    path = tmp_path / "ranks"
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"xy"]
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % (2 * k) for k, t in enumerate(tokens)))
    v = byte_bpe.Vocabulary.read(str(path), public_tokenizers.PATTERN)
    assert v.wholes == {b"abc": 512}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: 2 * k for k, t in enumerate(tokens)}, special_tokens={})
    codec = byte_bpe.Codec(v)
    for text in ("abc", "abcx xyxy xy", " abc.abc"):
        assert list(np.frombuffer(codec.encode(text), "<u4")) == want.encode_ordinary(text)
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="all bytes"):
        byte_bpe.Vocabulary.read(str(path), public_tokenizers.PATTERN)


# 13 source divergence


def divergence_brute(rows, least, top=50):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in df.items() if n >= least]
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + (10**9 * (counts[t] + 5)) // (n + 5 * v) for t in kept}

        counts = defaultdict(Counter)
        for _, s, c in mine:
            counts[s].update(c)
        whole = shares(sum(counts.values(), Counter()))
        p = {s: shares(c) for s, c in counts.items()}
        for s in counts:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s], "term": [(t, p[s][t] - whole[t]) for t in kept if counts[s][t] and p[s][t] > whole[t]]}
            for part, items in parts.items():
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out[lang, s, part, item, value, rank] += 1
    return out


def diverged(df, least, top=50):
    return Counter(map(tuple, divergence.source_divergence(df, least, top).collect()))


def speech(seed, n=400):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "É", "日本", "x1y", "a_b", "Zz", "q'r", "ß", "\U0001f600"] + [f"w{chr(97 + k)}{chr(97 + k // 3)}" for k in range(25)]
    rows = []
    for _ in range(n):
        source = rng.choice(["a", "a", "a", "b", None, "", "c"])
        rows.append((rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 30)))] + [" ".join(rng.choices(words[: 8 + 9 * (source == "a")], k=12))] * 4), rng.choice(["en", "en", None, "fr"]), source))
    return rows + [("only here", "xx", "a"), ("", "yy", "a"), (None, "yy", "b")]


@pytest.mark.parametrize("least,top", [(30, 50), (3, 4), (1, 50)])
def test_divergence_of_random_speech(spark, least, top):
    rows = speech(least)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, source string, n int, term string")
    assert diverged(df, least, top) == divergence_brute(rows, least, top)


def test_divergence_with_a_crowded_sketch_merged_in_levels(spark, monkeypatch):
    """So few cells that nearly all estimates are too high: nothing is lost, the exact counts decide."""
    monkeypatch.setattr(divergence, "LEAST_BITS", 4)
    monkeypatch.setattr(divergence, "MOST_BITS", 4)
    monkeypatch.setattr(divergence, "FAN_IN", 2)
    rows = speech(11)
    assert diverged(spark.createDataFrame(rows, "text string, lang string, source string").repartition(9), 30) == divergence_brute(rows, 30)


def test_sketch_never_underestimates_and_refuses_rare_terms(spark):
    rows = [("common", "en", "s")] * 40 + [(f"rare{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}", "en", "s") for k in range(100)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    reached = divergence.possible_cells(df, 30, 16, 5)
    assert 1 <= np.unpackbits(reached).sum() <= divergence.DEPTH
    counts, _ = divergence.source_terms(df, 30)
    assert [tuple(r) for r in counts.collect()] == [("en", "s", "common", 40)]


def test_divergence_of_documents_and_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert Counter(map(tuple, queries.op13_source_divergence(spark, SF).collect())) == divergence_brute(rows, 30)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    n, total, v = 10**15 + 7, 3 * 10**15 + 1, 10**9
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("z")).first()
    assert got.p == 1 + 10**9 * (n + 5) // (total + 5 * v) and got.z == 1
