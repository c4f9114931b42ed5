"""Byte-level BPE by speculation and verification.

A word's tokens are proposed by greedy longest match. A sequence of tokens is what merging would
give exactly if every adjacent pair is compatible, that is, if merging the bytes of the two would
give the same two tokens; this is tested for all distinct pairs of a batch at once. Only words with
an incompatible pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pick, slices
from .wordcodes import ChunkCodes

# The word pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points whose classes do not depend on the Unicode version of a regex library.
SETTLED = "[^\\t\\n\\r\\x20-\\x84\\x86-\\u0557\\u0cdd-\\u208e\\u3000-\\u9fff]"
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each token, by id."""
    letters = byte_letters()
    ids = spec["model"]["vocab"]
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    out = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        out[i] = bytes(letters[c] for c in token)
    for content, i in special.items():
        out[i] = content.encode()
    return out


def decode(tokens: list[bytes], ids: np.ndarray) -> str:
    return b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Merges:
    """Merge table of a byte-level vocabulary and exact merging.

    Where the vocabulary marks word ends, the last byte of a word starts as the byte with that mark.
    """

    def __init__(self, path: str):
        spec = _spec(path)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        mark = spec["model"].get("end_of_word_suffix") or ""
        self.byte_id, self.end_id = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for letter, b in letters.items():
            self.byte_id[b], self.end_id[b] = ids.get(letter, -1), ids.get(letter + mark, -1)
        size = max(ids.values()) + 1
        # Children and rank of the merge that makes a token; bytes have rank -1.
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[a + b]
            a, b = ids[a], ids[b]
            self.merge[a, b] = (r, made)
            self.left[made], self.right[made], self.rank[made] = a, b, r
        self.made = np.zeros(len(self.merge), np.int64)
        for rank, token in self.merge.values():
            self.made[rank] = token
        order = sorted(self.merge)
        self.pair_keys = np.array([a << 32 | b for a, b in order] + [NEVER], np.int64)
        self.pair_ranks = np.array([self.merge[p][0] for p in order] + [NEVER], np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost at equal rank."""
        raw = np.frombuffer(word, np.uint8)
        tokens = [*self.byte_id[raw[:-1]].tolist(), *self.end_id[raw[-1:]].tolist()]
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        heap = [(merge[p][0], i, *p) for i, p in enumerate(zip(tokens, tokens[1:])) if p in merge]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = merge[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (tokens[i], tokens[k])) in merge:
                    heapq.heappush(heap, (merge[p][0], i, *p))
            if (h := before[i]) >= 0 and (p := (tokens[h], tokens[i])) in merge:
                heapq.heappush(heap, (merge[p][0], h, *p))
        return [t for t in tokens if t >= 0]

    def merged_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words, not empty: tokens of all, and how many each has.

        Each round makes one merge in every word that is left; words beyond 64 bytes are merged singly.
        """
        long = [i for i, w in enumerate(words) if len(w) > 64]
        singly = {i: self.merged(words[i]) for i in long}
        words = [b"" if i in singly else w for i, w in enumerate(words)] if long else words
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tokens = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        if len(tokens):
            last = np.cumsum(sizes)[sizes > 0] - 1
            tokens[last] = self.end_id[np.frombuffer(b"".join(words), np.uint8)[last]]
        ranks = np.full(len(tokens), NEVER)  # of a token with the next of its word
        inside = np.flatnonzero(word[:-1] == word[1:])
        ranks[inside] = self.pair_rank(tokens[inside], tokens[inside + 1])
        out_words, out_tokens = [np.repeat(long, [len(singly[i]) for i in long]).astype(np.int64)], [np.array([t for i in long for t in singly[i]], np.int64)]
        while len(tokens):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(tokens)])
            least = np.minimum.reduceat(ranks, starts)
            ended = least == NEVER
            if ended.any():
                done = np.repeat(ended, sizes)
                out_words.append(word[done])
                out_tokens.append(tokens[done])
                tokens, word, ranks = tokens[~done], word[~done], ranks[~done]
                least, sizes = least[~ended], sizes[~ended]
            if not len(tokens):
                break
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            at = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]
            tokens[at] = self.made[least]
            stays = np.ones(len(tokens), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))  # one token went before each later place
            tokens, word, ranks = tokens[stays], word[stays], ranks[stays]
            for left in (at, at[at > 0] - 1):
                pair = left + 1 < len(tokens)
                left = left[pair]
                same = word[left] == word[left + 1]
                near = left[same]
                ranks[left[~same]] = NEVER
                ranks[near] = self.pair_rank(tokens[near], tokens[near + 1])
            ranks[-1] = NEVER
        of, flat = np.concatenate(out_words), np.concatenate(out_tokens)
        return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


class Vocabulary(Merges):
    def __init__(self, path: str):
        super().__init__(path)
        spec = _spec(path)
        ids = spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.text = token_bytes(spec)
        good = self._made_by_merging()
        self.ids = {self.text[i]: i for i in ids.values() if good[i]}
        # Length of the longest token with these first four bytes; other tokens are shorter than that.
        self.longest: dict[bytes, int] = {}
        for text in self.ids:
            if len(text) > 3:
                self.longest[text[:4]] = max(self.longest.get(text[:4], 4), len(text))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words, self.unsettled = regex.compile(WORDS), re.compile(SETTLED)
        self.chunks = re.compile(r" ?\S+|\s+(?!\S)|\s+")
        self.path, self._library = path, None
        self.codes = ChunkCodes(self.code_chunks)

    # Verification

    def compatible(self, a: np.ndarray, b: np.ndarray, from_top: bool = True) -> np.ndarray:
        """Whether merging the bytes of a and b leaves the boundary between them, for arrays of pairs.

        Walks back in merge order over the tokens that once touched the boundary. A merge over the
        boundary happens if its rank comes before the merge that took either neighbour away; at equal
        rank the pair further left comes first. With ``from_top`` false the pair itself is not tested.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        fine = np.ones(len(a), bool)
        taken_a, taken_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        open_, first = np.arange(len(a)), True
        while len(open_):
            x, y = a[open_], b[open_]
            if from_top or not first:
                crossing = self.pair_rank(x, y)
                broken = (crossing < taken_a[open_]) & (crossing <= taken_b[open_]) & (crossing != NEVER)
                fine[open_[broken]] = False
                open_, x, y = open_[~broken], x[~broken], y[~broken]
            first = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            more = np.maximum(rank_x, rank_y) >= 0
            open_, x, y, rank_x, rank_y = open_[more], x[more], y[more], rank_x[more], rank_y[more]
            newer = rank_x > rank_y
            at = open_[newer]
            taken_a[at], a[at] = rank_x[newer], self.right[x[newer]]
            at = open_[~newer]
            taken_b[at], b[at] = rank_y[~newer], self.left[y[~newer]]
        return fine

    def _made_by_merging(self) -> np.ndarray:
        """Tokens that merging their own bytes gives back."""
        good = self.rank < 0
        made = np.flatnonzero(self.rank >= 0)
        own = self.compatible(self.left[made], self.right[made], from_top=False)
        for i, fine in sorted(zip(made.tolist(), own.tolist()), key=lambda t: self.rank[t[0]]):
            good[i] = fine and good[self.left[i]] and good[self.right[i]]
        return good

    # Words

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            size = longest.get(word[at : at + 4], 3)
            if size > n - at:
                size = n - at
            while (token := ids.get(word[at : at + size])) is None:
                size -= 1
                if size == 0:
                    raise ValueError(f"the vocabulary lacks byte {word[at]}")
            out.append(token)
            at += size
        return out

    def code_words(self, words: list[bytes]) -> list[list[int]]:
        coded = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((t for c in coded for t in c), np.int64, int(sizes.sum()))
        if len(flat) < 2:
            return coded
        word_of = np.repeat(np.arange(len(coded)), sizes)
        inside = word_of[1:] == word_of[:-1]
        pairs, place = np.unique((flat[:-1] << 32 | flat[1:])[inside], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failing = np.unique(word_of[1:][inside][~fine[place]]).tolist()
        flat, sizes = self.merged_together([words[i] for i in failing])
        flat, end = flat.tolist(), 0
        for i, size in zip(failing, sizes.tolist()):
            coded[i] = flat[end : end + size]
            end += size
        return coded

    def code_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of new chunks; a chunk is a special token, or text that whole words make up."""
        split = [[] if c in self.special else [w.encode() for w in self.words.findall(c)] for c in chunks]
        distinct = list(dict.fromkeys(w for words in split for w in words))
        codes = dict(zip(distinct, self.code_words(distinct)))
        out, sizes = [], []
        for c, words in zip(chunks, split):
            before = len(out)
            if c in self.special:
                out.append(self.special[c])
            for w in words:
                out += codes[w]
            sizes.append(len(out) - before)
        return np.array(out, np.int32), np.array(sizes, np.int64)

    def chunked(self, text: str) -> list[str]:
        """Chunks whose words are the words of the text."""
        if self.special_split is not None and any(s in text for s in self.special):
            out = []
            for i, part in enumerate(self.special_split.split(text)):
                out += [part] if i % 2 else self.chunked(part)
            return out
        if self.unsettled.search(text):
            # Rare letters: the library's own word borders, as its Unicode tables decide.
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.chunks.findall(text)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.codes.encode([self.chunked(t) if t else [] for t in texts])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit, as binary).

    ``path`` names a byte-level BPE file that every node has. One row per input row, in no order;
    a null id stays null, a null or empty text has no tokens, other columns are left out, equal rows
    give equal rows, an empty table an empty one. Narrow: no shuffle.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for part in slices(batches, "text"):
            ids = voc.encode(part.column("text").to_pylist())
            yield pa.record_batch(
                [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                schema=schema,
            )

    return rows.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts of token ids as ``encode_documents`` stores them: ``doc_id, text`` and the columns of ``keep``.

    Special tokens are kept; bytes that are not UTF-8 become U+FFFD; null ids give a null text.
    """
    rows = pick(df, doc_id=id_col, ids=ids_col, **{k: k for k in keep})
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(_spec(path))
        for part in slices(batches, "ids"):
            texts = [None if x is None else decode(tokens, np.frombuffer(x, "<u4")) for x in part.column("ids").to_pylist()]
            columns = [part.column("doc_id"), pa.array(texts, pa.string()), *[part.column(k) for k in keep]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", *keep])

    return rows.mapInArrow(run, f"doc_id long, text string{', ' + kept if kept else ''}")
