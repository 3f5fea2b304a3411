"""BPE and token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import bpe, token_counts

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = "abcdefghij rstlne'0123 \n\t!?.,<|endoftext|>éÉßİΣ̈中\x1c\xa0  ſ🙂don't'S՘Ꟊ"


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(n)] + ["x<|endoftext|> y<|startoftext|>"]


def test_codec_equals_library(word):
    c = bpe.codec(bpe.read_spec(WORD))
    for s in strings(4_000, 1):
        ids = word.encode(s, add_special_tokens=False).ids
        assert c.encode(s) == packed(ids), repr(s)
        assert c.decode(packed(ids)).decode() == word.decode(ids, skip_special_tokens=False), repr(s)


def test_simple_chunks_need_no_library(word):
    """Below U+0180 the classes and lower case of the fast path are the library's."""
    for a in range(0x180):
        s = chr(a)
        if not regex.match(r"\s", s):
            for t in ("a" + s, "!" + s, "1" + s):
                c = bpe.codec(bpe.read_spec(WORD))
                assert bpe.SIMPLE(t) and c._chunk(t) == packed(word.encode(t, add_special_tokens=False).ids), hex(a)


def test_long_words_are_linear(word):
    c = bpe.codec(bpe.read_spec(WORD))
    rng = random.Random(2)
    for s in ("a" * 50_000, "".join(rng.choice("abcdeth") for _ in range(20_000))):
        assert c.encode(s) == packed(word.encode(s, add_special_tokens=False).ids)


def test_merges_equal_ranked_merging():
    """Backtracking against the plain rule: merge the pair of lowest rank, leftmost first, until none is left."""
    letters = bpe.byte_symbols()[:256]
    rng = random.Random(3)
    base = [letters[ord(c)] for c in "abc"]
    names, merges = list(base), []
    while len(merges) < 40:
        a, b = rng.choice(names), rng.choice(names)
        if a + b not in names and len(a + b) < 9:
            names.append(a + b)
            merges.append([a, b])
    vocab = {s: i for i, s in enumerate([*letters, *(x for x in names if len(x) > 1)])}
    m = bpe.Merges({"vocab": vocab, "merges": merges})
    rank = {tuple(p): i for i, p in enumerate(merges)}
    for _ in range(3_000):
        w = [rng.choice(base) for _ in range(rng.randrange(1, 14))]
        parts = list(w)
        while (best := min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)) is not None:
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert m.encode("".join(w)) == [vocab[p] for p in parts]


def test_encode_and_decode(spark, docs, awkward, none, word):
    out = bpe.encode(docs.withColumns({"token_ids": F.lit("mine"), "N_TOKENS": F.lit(1)}), WORD, decoded=True)
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens", "decoded"]
    got = sorted((str(r["doc_id"]), str(r["text"]), bytes(r["token_ids"]), r["n_tokens"], r["decoded"]) for r in out.collect())
    want = []
    for r in awkward:
        ids = word.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), str(r[1]), packed(ids), len(ids), word.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    again = bpe.decode(out.select("doc_id", "token_ids", F.col("decoded").alias("was")), WORD)
    assert again.where("was <> decoded").count() == 0 and again.count() == len(awkward)
    assert bpe.encode(none, WORD, decoded=True).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,), (bytearray(),)], "token_ids binary"), WORD).where("decoded = ''").count() == 2


def test_op1_columns(spark, tmp_path, docs, awkward, word):
    from larder.llm.queries import op1_bpe

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op1_bpe(spark, str(tmp_path)).collect()
    by = {r["doc_id"]: r for r in rows}
    for i, t, *_ in awkward:
        if i is not None:
            ids = word.encode(t or "", add_special_tokens=False).ids
            r = by[i]
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_counts_equal_library(spark, docs, awkward, none, monkeypatch):
    lib = Tokenizer.from_file(BYTE)
    data = [(i, s) for i, s in enumerate(strings(2_000, 4))] + [(10_000 + i, r[1]) for i, r in enumerate(awkward)]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_tokens", F.lit("mine"))
    got = {r["doc_id"]: r for r in token_counts.count_tokens(frame, BYTE, limit=20).collect()}
    for i, s in data:
        n = len(lib.encode(s or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((s or "").encode()), n > 20), repr(s)
    assert token_counts.count_tokens(none, BYTE).count() == 0


def test_counts_with_full_caches():
    lib = token_counts.library(bpe.read_spec(BYTE))
    token_counts_cache, token_counts.CACHE = token_counts.CACHE, 5
    try:
        c = token_counts.Counts(lib)
        for s in strings(500, 5) + ["a b c d e f g h i j k a b c d e f g h i j k " + "w" * 99] * 2:
            assert c.total(s, {"b": 1}) == len(lib.encode(s, add_special_tokens=False).ids)
    finally:
        token_counts.CACHE = token_counts_cache


def test_frequent_lengths_are_the_library_s():
    lib = Tokenizer.from_file(BYTE)
    table = token_counts.frequent_lengths(lib)
    assert 10_000 < len(table) <= lib.get_vocab_size() and {"the", "of", "and"} <= set(table)
    assert all(len(p) <= token_counts.CACHED_CHARS and token_counts.pieces("x " + p) == ["x", p] for p in table)
    assert all(table[p] == len(lib.encode(" " + p, add_special_tokens=False).ids) for p in sorted(table)[::97])
