"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

A sequence of tokens is the BPE encoding of its text exactly if every two
neighbours, encoded on their own, stay the same two tokens. So each prefix of
a word has one possible last token: a token that ends there and is a stable
neighbour of the last token of the prefix before it. The transducer keeps the
last token for the newest ``lookahead`` prefixes only. That many suffice:
a token spans at most that many symbols, so no later token can start before
them, and a boundary through which the chains of all of them lead is final.
Tokens before it are emitted and forgotten.

Words of bounded length are looked up in a bounded cache first; the cache
holds what the transducer gave.

Null texts count as empty (no tokens). Texts of white space only have no
tokens. Rows are kept as they are, repeated ones and null ids too; other
columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import map_slices

#: Words longer than this are streamed and never cached.
CACHED_CHARS = 64
#: Entries of a worker's word cache, emptied when full.
CACHE_WORDS = 1_000_000
#: Symbols that a word is cut to for one feed of the transducer.
FEED = 4096


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is a
    visible Latin-1 character, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for byte in range(256):
        if byte in visible:
            out.append(chr(byte))
        else:
            out.append(chr(free))
            free += 1
    return out


class Vocabulary:
    """Token ids, merge ranks and text rules of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: r for r, p in reversed(list(enumerate(pairs)))}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_ids = set(self.specials.values())
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.symbols = byte_symbols()
        self.bytes_of = {s: b for b, s in enumerate(self.symbols)}
        self.lookahead = self.sufficient_lookahead()
        self._stable: dict[tuple[str, str], bool] = {}
        self._alone: dict[str, bool] = {}

    def sufficient_lookahead(self) -> int:
        """Symbols of the longest token a merge can make: a boundary further
        back than this from the read head can get no new token across it."""
        return max((self.length(a) + self.length(b) for a, b in self.ranks), default=1)

    def length(self, token: str) -> int:
        return len(token) - len(self.end) if self.end and token.endswith(self.end) else len(token)

    def parts(self, token: str) -> list[str]:
        """A token's single symbols; the last one carries the word end."""
        n = self.length(token)
        return [*token[:n - 1], token[n - 1:]]

    def merged(self, parts: list[str]) -> list[str]:
        """The merges in their order on a few symbols (at most two tokens)."""
        parts = list(parts)
        while len(parts) > 1:
            rank, i = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def alone(self, token: str) -> bool:
        """Whether a token's text is encoded as that token."""
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = token in self.ids and self.merged(self.parts(token)) == [token]
        return known

    def stable(self, left: str, right: str) -> bool:
        """Whether two neighbours stay the same two tokens."""
        key = left, right
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > 4_000_000:
                self._stable.clear()
            known = self._stable[key] = self.merged([*left, *self.parts(right)]) == [left, right]
        return known

    def normal(self, text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is no special case)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(word, None) or (special, id), in order. Specials are found in the
        raw text, words in the normal form of what lies between."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from ((w, None) for w in self.word.findall(self.normal(text[at:m.start()])))
            yield m[0], self.specials[m[0]]
            at = m.end()
        yield from ((w, None) for w in self.word.findall(self.normal(text[at:])))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class StreamEncoder:
    """Encodes one word fed symbol by symbol.

    ``feed`` gives tokens once they are final, ``finish`` ends the word and
    gives the rest. The newest symbol waits until it is known whether it ends
    the word."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self._reset()

    def _reset(self) -> None:
        self.wait, self.tail = "", ""
        self.at = self.done = 0
        self.last: dict[int, str] = {0: ""}  # position: last token of the prefix that ends there

    def _push(self, symbol: str, end: str) -> None:
        v, last = self.v, self.last
        tail = self.tail = (self.tail + symbol)[-v.lookahead:]
        self.at = at = self.at + 1
        for size in range(min(len(tail), at), 0, -1):
            token = tail[-size:] + end
            if token in v.ids and v.alone(token):
                before = last.get(at - size)
                if before is not None and (not before or v.stable(before, token)):
                    last[at] = token
                    return
        raise ValueError(f"no token ends {tail!r}")

    def _chain(self, end: int) -> list[str]:
        """The tokens between the emitted ones and position ``end``."""
        out = []
        while end > self.done:
            out.append(self.last[end])
            end -= self.v.length(out[-1])
        return out[::-1]

    def _settled(self) -> list[str]:
        """Tokens before the position that the chains of all newest
        ``lookahead`` prefixes share; no later token can start before it."""
        ends = set(range(max(self.done, self.at - self.v.lookahead), self.at + 1))
        while len(ends) > 1:
            p = max(ends)
            ends.remove(p)
            ends.add(p - self.v.length(self.last[p]))
        shared = ends.pop()
        out = self._chain(shared)
        if out:
            self.last = {p: t for p, t in self.last.items() if p >= shared}
            self.done = shared
        return out

    def feed(self, symbols: str) -> list[str]:
        out = []
        for symbol in symbols:
            if self.wait:
                self._push(self.wait, "")
                if (self.at - self.done) % (4 * self.v.lookahead) == 0:
                    out += self._settled()
            self.wait = symbol
        return out

    def finish(self) -> list[str]:
        if not self.wait:
            return []
        self._push(self.wait, self.v.end)
        out = self._chain(self.at)
        self._reset()
        return out


class StreamDecoder:
    """Ids to text, one id at a time.

    ``pieces``: what the library gives for a file without a decoder, the
    tokens parted by one space. Otherwise the bytes the tokens stand for, as
    text: a state machine holds back the bytes of an unfinished character, a
    word end gives one space."""

    def __init__(self, vocab: Vocabulary, pieces: bool = True):
        self.v, self.pieces = vocab, pieces
        self._first = True
        self._utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, token_id: int) -> str:
        token = self.v.tokens[token_id]
        if self.pieces:
            out = token if self._first else " " + token
            self._first = False
            return out
        if token_id in self.v.special_ids:
            return self._utf8.decode(b"", True) + token
        n = self.v.length(token)
        data = bytes(self.v.bytes_of[c] for c in token[:n])
        return self._utf8.decode(data) + (" " if n < len(token) else "")

    def finish(self) -> str:
        return self._utf8.decode(b"", True)


class WordCache(dict):
    """Word -> its ids, from the transducer; emptied when full, long words are not kept."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.v, self.encoder = vocab, StreamEncoder(vocab)

    def __missing__(self, word: str) -> tuple[int, ...]:
        v, out = self.v, []
        data = word.encode("utf-8")
        for i in range(0, len(data), FEED):
            out += self.encoder.feed("".join(map(v.symbols.__getitem__, data[i:i + FEED])))
        ids = tuple(map(v.ids.__getitem__, out + self.encoder.finish()))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def cache(path: str) -> WordCache:
    return WordCache(vocabulary(path))


def encode_text(text: str | None, path: str) -> list[int]:
    known = cache(path)
    vocab = known.v
    if not text:
        return []
    if not (vocab.special and vocab.special.search(text)):
        return list(chain.from_iterable(map(known.__getitem__, vocab.word.findall(vocab.normal(text)))))
    return list(chain.from_iterable((i,) if i is not None else known[w] for w, i in vocab.pieces(text)))


def decode_ids(ids: Iterable[int], path: str, pieces: bool = True) -> str:
    decoder = StreamDecoder(vocabulary(path), pieces)
    return "".join(map(decoder.feed, ids)) + decoder.finish()


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``ids`` (array of int) and ``decoded`` (string) of every row.

    One pass without a shuffle; a worker holds the vocabulary, the word cache
    and one slice of texts."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        names = vocabulary(path).tokens.__getitem__
        ids = [encode_text(t, path) for t in part.column(1).to_pylist()]
        # the decoder's "pieces" state machine, on a whole list of ids at once
        decoded = [" ".join(map(names, x)) for x in ids]
        return pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                               names=[id_column, "ids", "decoded"])

    rows = df.select(F.col(id_column), F.col(text_column))
    kind = rows.schema[0].dataType.simpleString()
    return map_slices(rows, work, f"`{id_column}` {kind}, ids array<int>, decoded string", 1)
