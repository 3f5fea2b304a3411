"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives, for every position of a word, the longest
token that starts there. Tokens are laid from the left; a token may follow another only if the
merge rules, applied to both together, would leave their boundary in place (the pair is
compatible). Where no token fits, the last one is taken back and a shorter prefix tried; each
position is given up at most once, so the work is linear in the word. The result equals applying
the merges in order of rank.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larder.llm.common import extended, mapped, sliced, texts, with_fields, without

#: A word's last symbol, where the vocabulary marks word ends, is its byte's symbol plus this.
END = 0x1000
#: Entries of a worker's cache of encoded chunks, and the longest chunk it holds.
CACHE, CACHED_CHARS = 400_000, 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    free, out = 0x100, []
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Merges:
    """The tables of one vocabulary: automaton, next shorter prefix of each token, splits and pair ranks."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""

        def symbols(token: str) -> str:
            body = token.removesuffix(suffix) if suffix else token
            return body[:-1] + chr(ord(body[-1]) + END) if body and body != token else token

        base = [c for c in byte_symbols()] + ([chr(ord(c) + END) for c in byte_symbols()] if suffix else [])
        spelled = {symbols(t): i for t, i in vocab.items()}
        rank = {s: r for r, s in enumerate(base)}
        self.left, self.right = list(range(len(base))), list(range(len(base)))
        self.pair: dict[tuple[int, int], int] = {}
        names = list(base)
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = symbols(a), symbols(b)
            if a + b in rank:
                raise ValueError(f"two merges make the token {a + b!r}")
            new = len(names)
            self.left.append(rank[a])
            self.right.append(rank[b])
            self.pair[rank[a], rank[b]] = new
            rank[a + b] = new
            names.append(a + b)
        self.length = [len(s) for s in names]
        self.ids = [spelled[s] for s in names]
        self.compatible: dict[tuple[int, int], bool] = {}
        n, whole = len(base), [True] * len(base)
        for t in range(n, len(names)):
            a, b = self.left[t], self.right[t]
            whole.append(whole[a] and whole[b] and self._stays(a, b, t))
        self.automaton = ahocorasick.Automaton()
        for t, s in enumerate(names):
            if whole[t]:
                self.automaton.add_word(s, t)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(names)
        reachable = {s: t for t, s in enumerate(names) if whole[t]}
        for s, t in reachable.items():
            self.shorter[t] = next((reachable[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in reachable), -1)

    def _stays(self, a: int, b: int, limit: int) -> bool:
        """Whether the boundary of a and b outlasts all merges of a rank below limit: undo the later merge of the two sides, step by step, and look for one across the boundary that comes before it."""
        pair, left, right = self.pair, self.left, self.right
        while True:
            merged = pair.get((a, b))
            if merged is not None and merged < limit:
                return False
            undo_a = left[a] != a and (a > b or left[b] == b)
            if not undo_a and left[b] == b:
                return True
            if undo_a:
                limit, a = min(limit, a), right[a]
            else:
                limit, b = min(limit, b + 1), left[b]

    def follows(self, a: int, b: int) -> bool:
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) >= CACHE:
                self.compatible.clear()
            known = self.compatible[a, b] = self._stays(a, b, len(self.length))
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of one word, given in symbols."""
        n = len(word)
        longest = [-1] * n
        length, shorter, follows = self.length, self.shorter, self.follows
        for end, t in self.automaton.iter(word):
            longest[end + 1 - length[t]] = t  # ends ascend: the last one written is the longest
        if n and length[longest[0]] == n:
            return [self.ids[longest[0]]]
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if open_[end] and (last < 0 or follows(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if last < 0:
                    raise ValueError("the vocabulary cannot spell this word")
                open_[at] = 0
                out.pop()
                at -= length[last]
                token = last
        return [self.ids[t] for t in out]


class Codec:
    """Encoder and decoder of a tokenizer file with word ends whose pre-tokenizer drops white space."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        self.merges = Merges(conf["model"])
        self.suffix = bool(conf["model"].get("end_of_word_suffix"))
        self.added = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.library = Tokenizer.from_str(spec)  # its normalizer and splitter serve characters outside SIMPLE
        pattern = next(p["pattern"]["Regex"] for p in conf["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.symbol = byte_symbols()
        names = {i: t for t, i in conf["model"]["vocab"].items()} | {i: t for t, i in self.added.items()}
        spelled = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.cache = _Cache(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a chunk without white space."""
        if SIMPLE(chunk):
            pieces = ["".join([self.symbol[b] for b in p.encode()]) for p in self.split.findall(chunk.lower())]
        else:
            pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]
        ids: list[int] = []
        for p in pieces:
            ids += self.merges.encode(p[:-1] + chr(ord(p[-1]) + END) if self.suffix else p)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        if "<|" in text and len(parts := self.special.split(text)) > 1:
            return b"".join(np.array([self.added[p]], "<u4").tobytes() if i % 2 else self.encode(p) for i, p in enumerate(parts))
        chunks = regex.split(r"\s+", text) if CONTROLS.search(text) else text.split()
        return b"".join(map(self.cache.__getitem__, chunks))

    def decode(self, packed: bytes) -> bytes:
        """The tokens' strings joined by spaces, in UTF-8: one gather from the table of all strings, in blocks."""
        ids, out = np.frombuffer(packed, "<u4").astype(np.int64), []
        for k in range(0, len(ids), 65_536):
            part = ids[k : k + 65_536]
            n = self.size[part]
            ends = np.cumsum(n)
            out.append(self.blob[np.repeat(self.offset[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


#: Python's split() also cuts at these; the tokenizer's white space does not hold them.
CONTROLS = re.compile("[\x1c-\x1f]")
#: Chunks of characters below U+0180 only: no combining marks, classes and lower case alike in every Unicode version.
SIMPLE = re.compile("[\x00-ſ]*").fullmatch


class _Cache(dict):
    """Encoded chunks of this worker; emptied when full, so its memory is bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        made = self.make(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = made
        return made


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    """One codec per worker and tokenizer."""
    return Codec(spec)


def read_spec(path: str) -> str:
    """A tokenizer file's text; the driver reads it, so executors need no copy."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """docs with `token_ids` (binary, little-endian unsigned 32-bit), `n_tokens` (long) and, if asked, `decoded` (string).

    Equal to the tokenizers library without added special tokens, truncation or padding; special
    strings inside texts count as special, as is its default. Null and empty texts give empty ids
    and an empty decoded string. Repeated rows are encoded as often as they occur. Input columns
    of the new names are replaced. One map over the input: no shuffle; the broadcast is the
    tokenizer file.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    new = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), *[T.StructField("decoded", T.StringType())] * decoded]
    docs = without(docs, [f.name for f in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col))
            sizes = ((i, 12 * (len(x.as_buffer()) if x.is_valid else 0)) for i, x in enumerate(column))
            for start, stop in sliced(sizes):
                packed = [c.encode(t) for t in texts(column.slice(start, stop - start))]
                cols = {"token_ids": pa.array(packed, pa.binary()), "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64())}
                if decoded:
                    cols["decoded"] = pa.array([c.decode(p) for p in packed], pa.binary()).cast(pa.string())
                yield extended(batch.slice(start, stop - start), cols)

    return docs.transform(mapped, run, with_fields(docs, new))


def decode(tokens: DataFrame, tokenizer_path: str, ids_col: str = "token_ids") -> DataFrame:
    """tokens with `decoded` (string) from packed ids; null and empty ids give the empty string. Ids outside the vocabulary raise."""
    spec = tokens.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    tokens = without(tokens, ["decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids_col))
            for start, stop in sliced((i, 3 * (len(x.as_buffer()) if x.is_valid else 0)) for i, x in enumerate(column)):
                out = [c.decode(x.as_py() or b"") for x in column.slice(start, stop - start)]
                yield extended(batch.slice(start, stop - start), {"decoded": pa.array(out, pa.binary()).cast(pa.string())})

    return tokens.transform(mapped, run, with_fields(tokens, [T.StructField("decoded", T.StringType())]))
