"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word exactly one vocabulary entry can end its encoding. A
suffix automaton over the vocabulary yields all entries that end at a position,
longest first; the one that is compatible with the unique last entry of the
prefix before it is stored. Back-pointers then give the exact ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words remembered by one Python worker: twice as many at most.
WORD_CACHE = 400_000
PAIR_CACHE = 1_000_000
#: Fixed value: the pre-tokenizer pattern of word_bpe_49k.json.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class SuffixAutomaton:
    """Of a set of strings of small integers; each string is inserted from the root."""

    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        self.length, self.link, self.entry, self.next = [0], [-1], [-1], {}
        self._out: list[list[int]] = [[]]  # symbols that leave each state

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.entry.append(-1)
        self._out.append([])
        return len(self.length) - 1

    def _set(self, state: int, symbol: int, to: int) -> None:
        self._out[state].append(symbol)
        self.next[state * self.alphabet + symbol] = to

    def _split(self, p: int, symbol: int, q: int) -> int:
        """A state for the strings of q that p reaches; q keeps the longer ones."""
        n, nxt = self.alphabet, self.next
        clone = self._state(self.length[p] + 1)
        for c in self._out[q]:
            self._set(clone, c, nxt[q * n + c])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and nxt.get(p * n + symbol) == q:
            nxt[p * n + symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list[int], value: int) -> None:
        n, nxt, last = self.alphabet, self.next, 0
        for symbol in symbols:
            q = nxt.get(last * n + symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
                continue
            now, p = self._state(self.length[last] + 1), last
            while p >= 0 and p * n + symbol not in nxt:
                self._set(p, symbol, now)
                p = self.link[p]
            if p >= 0:
                q = nxt[p * n + symbol]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
            last = now
        self.entry[last] = value

    def finish(self) -> None:
        """For each state its nearest suffix state, itself included, that is an entry."""
        self.nearest, self._out = [-1] * len(self.length), []
        for s in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.nearest[s] = s if self.entry[s] >= 0 else (self.nearest[self.link[s]] if s else -1)


class WordBPE:
    """A vocabulary with word ends, read from a ``tokenizers`` JSON file's text."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or data.get("decoder") is not None:
            raise ValueError("expected a BPE model without a decoder")
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._piece = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if regex.match(rf"\p{{{k}}}", chr(c))) for k in ("L", "N", "White_Space")}
        rest = "".join(re.escape(chr(c)) for c in range(256) if not regex.match(r"[\p{White_Space}\p{L}\p{N}]", chr(c)))
        if pattern != PATTERN:
            raise ValueError("an unknown pre-tokenizer pattern")
        # the same pattern with its classes written out for code points below 256
        self._latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[{rest}]+")
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._symbols = byte_symbols()
        self._byte_of = {c: b for b, c in enumerate(self._symbols)}
        self._merges(model["merges"])
        self._automaton()
        self._pairs: dict[int, bool] = {}
        self._decimal = {str(i): t for i, t in self.token.items()}
        self._words = _Memory(self)

    def _merges(self, merges: list) -> None:
        self.rank: dict[int, int] = {}  # of the merge that makes an entry; single symbols have none
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = self.vocab[left + right]
            a, b = self.vocab[left], self.vocab[right]
            self.made[a, b] = rank
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, (a, b)

    def _coded(self, token: str) -> list[int]:
        """Bytes of an entry as numbers; the last has 256 added if it ends a word."""
        ends = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
        out = [self._byte_of[c] for c in (token[: -len(self.end)] if ends else token)]
        if ends:
            out[-1] += 256
        return out

    def _automaton(self) -> None:
        self.sam = SuffixAutomaton(512)
        for token, i in self.vocab.items():
            if i in self.parts or len(token.removesuffix(self.end) or token) == 1:
                self.sam.add(self._coded(token), i)
        self.sam.finish()

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left, right`` as they are when they stand side by side.

        Walks back from both entries over the merges that made them, latest
        first: at each point the two symbols at the border must not have been
        merged before the next of these merges took place.
        """
        known = self._pairs.get(left << 20 | right)
        if known is None:
            if len(self._pairs) >= PAIR_CACHE:
                self._pairs.clear()
            known = self._pairs[left << 20 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        rank, parts, made = self.rank, self.parts, self.made
        until, reaches = len(made), False
        while True:
            own = made.get((left, right))
            # merges of one rank happen from the left: before one that is undone on the
            # right, a pair of the same rank at the border comes first
            if own is not None and (own < until or own == until and reaches):
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                until, reaches = a, False
                left = parts[left][1]
            else:
                until, reaches = b, True
                right = parts[right][0]

    def encode_words(self, pieces: list[str]) -> Iterator[list[int]]:
        """The ids of each word; of words in order, prefixes shared with the word before are not redone."""
        sam, pairs, end = self.sam, self._pairs, 256 if self.end else 0
        nxt, link, length, entry, nearest = sam.next, sam.link, sam.length, sam.entry, sam.nearest
        last, size, states, matches = [-1], [0], [0], [0]  # by length of the prefix
        before = b""
        for piece in pieces:
            word = piece.encode("utf-8")
            n, same = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            # the last symbol differs from the same byte inside a word
            same = min(same, len(before) - 1, n - 1) if before else 0
            del last[same + 1 :], size[same + 1 :], states[same + 1 :], matches[same + 1 :]
            state, matched = states[same], matches[same]
            for at in range(same + 1, n + 1):
                symbol = word[at - 1] + (end if at == n else 0)
                while (to := nxt.get(state * 512 + symbol)) is None and state:
                    state = link[state]
                    matched = length[state]
                state, matched = (to, matched + 1) if to is not None else (0, 0)
                # a state's own entry is matched only if its whole string is
                s = nearest[state] if matched == length[state] else nearest[link[state]]
                found = width = -1
                while s > 0:
                    width, found = length[s], entry[s]
                    if width == at:
                        break
                    left = last[at - width]
                    if left >= 0:
                        fits = pairs.get(left << 20 | found)
                        if fits or fits is None and self.compatible(left, found):
                            break
                    found = -1
                    s = nearest[link[s]]
                last.append(found)
                size.append(width)
                states.append(state)
                matches.append(matched)
            ids, at = [], n
            while at:
                if last[at] < 0:
                    raise ValueError(f"no encoding: {piece!r}")
                ids.append(last[at])
                at -= size[at]
            before = word
            yield ids[::-1]

    def _pieces(self, part: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        # that every white space becomes one space changes nothing: pieces have none
        part = part if part.isascii() else unicodedata.normalize("NFC", part)
        part = part.replace("Σ", "σ").lower()  # of each character by itself: no final sigma
        try:
            part.encode("latin-1")
        except UnicodeEncodeError:
            return self._piece.findall(part)
        return self._latin.findall(part)

    def _runs(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens and, each in a list of its own, special tokens."""
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                yield [part]
            elif part:
                yield self._pieces(part)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.summary(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode without a decoder: entries joined by spaces."""
        return " ".join(self.token[i] for i in ids)

    def summaries(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, the ids in decimal joined by spaces, the decoded text) of each."""
        runs = [list(chain.from_iterable(self._runs(x or ""))) for x in texts]
        words = self._words.having(set(chain.from_iterable(runs)))
        for run in runs:
            decimal = " ".join(map(words.__getitem__, run)).split(" ") if run else []
            yield len(decimal), " ".join(decimal), " ".join(map(self._decimal.__getitem__, decimal))

    def summary(self, text: str | None) -> tuple[int, str, str]:
        return next(self.summaries([text]))


class _Memory:
    """The ids, in decimal, of the words met lately: those of the last two spans."""

    def __init__(self, bpe: WordBPE):
        self.bpe, self.now, self.past = bpe, {}, {}

    def having(self, words: set[str]) -> dict[str, str]:
        """The memory, with these words in it."""
        if len(self.now) > WORD_CACHE:
            self.now, self.past = {}, self.now
        now, past, bpe = self.now, self.past, self.bpe
        new = []
        for word in words.difference(now):
            if word in past:
                now[word] = past[word]
            elif word in bpe.special:
                now[word] = str(bpe.special[word])
            else:
                new.append(word)
        new.sort()
        for word, ids in zip(new, bpe.encode_words(new)):
            now[word] = " ".join(map(str, ids))
        return now


_LOADED: dict[str, WordBPE] = {}


def _loaded(spec: str) -> WordBPE:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBPE(spec)
    return _LOADED[key]


def read_spec(spark: SparkSession, path: str) -> str:
    """The vocabulary file's text: a file of the driver's, about 2 MB whatever the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", *, keep: list[Column] | None = None, ids: bool = True) -> DataFrame:
    """Rows of ``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, token_ids.

    ``keep`` are the columns carried along (all, unless given). A null text
    counts as empty and has no ids; ids are those of the vocabulary file at
    ``vocabulary``, its special tokens' strings included where a text has them.
    A carried column with the name of a new one is replaced.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(spark, vocabulary))
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else [])]
    base = docs.select(*(keep if keep is not None else [F.col(f"`{c}`") for c in docs.columns if c not in new]), F.col(f"`{text_col}`").alias("_mr_text"))
    types = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "token_ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*base.schema.fields[:-1], *[T.StructField(c, types[c]) for c in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                out: dict[str, list] = {c: [] for c in new}
                for n, decimal, decoded in bpe.summaries(batch.column(batch.num_columns - 1).to_pylist()):
                    out["n_tokens"].append(n)
                    out["ids_sha256"].append(hashlib.sha256(decimal.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        out["token_ids"].append([int(i) for i in decimal.split()])
                kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "token_ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(out[c], kinds[c]) for c in new]], [*batch.schema.names[:-1], *new])

    return base.mapInArrow(run, schema)
