"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token the table holds the one token that ends its encoding. Candidates
are the vocabulary entries that are suffixes of the prefix, given longest first by an automaton
with suffix links; a candidate is right if it can stand after the last token of the prefix it
leaves, that is, if no merge rule would ever fire across the border of the two. Back-pointers
from the full length give the ids, which equal those of the merge loop.

Texts with letters from U+0530 on are split into pre-tokens by the library, whose Unicode tables may
be of another version than ours; their ids come from the automaton like all others.

Defined results: a null or empty text has no ids and decodes to the empty text; a very long text is
encoded whole, and so is a pre-token of any length; repeated rows are encoded alike; an empty table gives
an empty table. Special strings of the vocabulary that stand in a text become their special id. Ids are
packed as little-endian unsigned 32-bit integers. Extra columns pass through; one that is named `to` is
replaced.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cache as memo

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, kept

#: Fixed value: the public byte-level splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point (before the Armenian letters) the classes of PATTERN agree between Unicode versions.
_COMMON_END = "\u0530"
_NEVER = 1 << 60
#: Entries that a worker's caches hold before they start anew; a bound on memory, not on work.
CACHE_ENTRIES = 250_000
#: Letters of a pre-token's start whose part of the table is kept for other pre-tokens that start alike.
STEM = 5


@memo
def byte_alphabet() -> dict[int, str]:
    """Byte -> letter of the byte-level alphabet: printable Latin-1 stays, the rest follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return letters


class Vocabulary:
    """Tokens, merge ranks and the automaton, from a tokenizer's JSON."""

    def __init__(self, spec: bytes):
        model = json.loads(spec)
        self.specials = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        ids: dict[str, int] = model["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.ids = ids
        back = {v: k for k, v in byte_alphabet().items()}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.specials.values()]))
        for letters, t in ids.items():
            self.bytes_of[t] = bytes(back[c] for c in letters if c in back)
        for content, t in self.specials.items():
            self.bytes_of[t] = content.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, (left, right) in enumerate(merges):
            pair = (ids[left], ids[right])
            self.rank.setdefault(pair, k)
            self.parts.setdefault(ids[left + right], (*pair, k))
        self._right: dict[int, tuple] = {}
        self._left: dict[int, tuple] = {}
        self._apart: list[dict[int, bool]] = [{} for _ in self.bytes_of]
        self._judged = 0
        self._stems: dict[str, tuple[int, list[int]]] = {}
        self.whole: dict[str, int] = {}
        reachable = set()
        made = sorted((t for t in ids.values()), key=lambda t: self.parts.get(t, (0, 0, -1))[2])
        text_of = {t: s for s, t in ids.items()}
        for t in made:
            if t in self.parts:
                left, right, k = self.parts[t]
                if not (left in reachable and right in reachable and not self.crossed(left, right, k)):
                    continue
            elif len(text_of[t]) != 1:
                continue
            reachable.add(t)
            self.whole[text_of[t]] = t
        self.build_automaton()

    def build_automaton(self) -> None:
        """A trie of the tokens with suffix links. ends[state]: the tokens that are suffixes of
        what has been read, longest first; moves[state] also gets the moves by suffix links, as
        they are first used."""
        self.moves: list[dict[str, int]] = [{}]
        own: list[tuple | None] = [None]
        for letters, t in self.whole.items():
            at = 0
            for c in letters:
                to = self.moves[at].get(c)
                if to is None:
                    to = self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    own.append(None)
                at = to
            own[at] = (t, len(letters))
        self.link, self.ends, self._jumps = [0] * len(own), [()] * len(own), []
        level = [0]
        while level:
            below = []
            for at in level:
                for c, to in self.moves[at].items():
                    if at:
                        back = self.link[at]
                        while back and c not in self.moves[back]:
                            back = self.link[back]
                        self.link[to] = self.moves[back].get(c, 0)
                    rest = self.ends[self.link[to]]
                    self.ends[to] = (own[to], *rest) if own[to] else rest
                    below.append(to)
            level = below

    def move(self, at: int, c: str) -> int:
        """A move that the trie itself doesn't have; kept for the next time, up to CACHE_ENTRIES."""
        back = at
        while back and c not in self.moves[back]:
            back = self.link[back]
        if len(self._jumps) >= CACHE_ENTRIES:
            for place, letter in self._jumps:
                del self.moves[place][letter]
            self._jumps.clear()
            return self.move(at, c)
        to = self.moves[at][c] = self.moves[back].get(c, 0)
        self._jumps.append((at, c))
        return to

    def edge(self, token: int, side: int) -> tuple:
        """The tokens that stand at one edge (0 left, 1 right) of a token while it is being
        built, each with the rank of the merge that uses it up."""
        memory = self._right if side else self._left
        if token not in memory:
            if token in self.parts:
                *halves, k = self.parts[token]
                inner = self.edge(halves[side], side)
                memory[token] = (*inner[:-1], (halves[side], k), (token, _NEVER))
            else:
                memory[token] = ((token, _NEVER),)
        return memory[token]

    def crossed(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether some merge of a rank below `until` fires across the border of a and b.

        Both edges grow in order of rank. Two tokens that face each other at some time merge if
        their rule comes before the left one is used up (of equal rules the left place goes
        first, so an equal rank uses the left one up), and no later than the right one is.
        """
        xs, ys = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = xs[i], ys[j]
            k = self.rank.get((x, y))
            if k is not None and k < x_end and k <= y_end and k < until:
                return True
            end = min(x_end, y_end)
            if end >= until or end == _NEVER:
                return False
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def fits(self, before: int, t: int) -> bool:
        """Whether t can follow `before` in an encoding; kept for the next time."""
        if self._judged >= 2 * CACHE_ENTRIES:
            for known in self._apart:
                known.clear()
            self._judged = 0
        self._judged += 1
        out = self._apart[t][before] = not self.crossed(before, t)
        return out

    def fill(self, letters: str, state: int, table: list[int]) -> tuple[int, list[int]]:
        """The automaton's state and the table of last tokens, both from those before `letters`."""
        end = len(table) - 1
        last = table + [-1] * len(letters)
        known, moves, ends = self._apart, self.moves, self.ends
        for c in letters:
            end += 1
            to = moves[state].get(c)
            state = self.move(state, c) if to is None else to
            for t, size in ends[state]:
                if size == end:
                    last[end] = t
                    break
                if (before := last[end - size]) >= 0:
                    fits = known[t].get(before)
                    if fits is None:
                        fits = self.fits(before, t)
                    if fits:
                        last[end] = t
                        break
        return state, last

    def encode_letters(self, letters: str) -> list[int]:
        """Ids of one pre-token in the byte-level alphabet."""
        if (t := self.whole.get(letters)) is not None:
            return [t]
        if len(letters) <= STEM:
            last = self.fill(letters, 0, [-1])[1]
        else:  # the table of a prefix is the same whatever follows it
            stem = letters[:STEM]
            if (held := self._stems.get(stem)) is None:
                if len(self._stems) >= CACHE_ENTRIES:
                    self._stems.clear()
                held = self._stems[stem] = self.fill(stem, 0, [-1])
            last = self.fill(letters[STEM:], *held)[1]
        out, at = [], len(letters)
        while at:
            t = last[at]
            out.append(t)
            at -= len(self.bytes_of[t])
        return out[::-1]


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Whole texts to packed ids, with bounded caches of pieces and pre-tokens."""

    def __init__(self, spec: bytes):
        self.vocabulary = Vocabulary(spec)
        self.split = regex.compile(PATTERN).findall
        self.space = byte_alphabet()[0x20]
        self.letters = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        names = sorted(self.vocabulary.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.special_names = names
        self.tokens: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = {c: self.token(c) for c in ".,;:!?"}
        self._library = None
        self._spec = spec

    def pretokens(self, text: str) -> list[str]:
        if not text or max(text) < _COMMON_END:
            return self.split(text)
        if self._library is None:  # letters that newer Unicode versions class otherwise
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._spec.decode()).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def token(self, pretoken: str) -> bytes:
        """Ids of one pre-token."""
        if pretoken.isascii() and pretoken.isprintable():
            letters = pretoken.replace(" ", self.space)
        else:
            letters = pretoken.encode().decode("latin-1").translate(self.letters)
        return pack(self.vocabulary.encode_letters(letters))

    def keep(self, piece: str, packed: bytes) -> bytes:
        """Remember the ids of a space and a piece; the older half goes when the newer is full,
        but for what has been used meanwhile."""
        if len(piece) <= 64:
            if len(self.pieces) >= CACHE_ENTRIES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = packed
        return packed

    def word(self, word: str) -> bytes:
        """Ids of a space and letters."""
        packed = self.pieces.get(word)
        if packed is None:
            packed = self.older.get(word)
            packed = self.keep(word, self.token(" " + word) if packed is None else packed)
        return packed

    def spaced(self, piece: str) -> bytes:
        """Ids of a space and a piece; a word, or a word and a mark, needs no splitting."""
        if piece.isalpha() and max(piece) < _COMMON_END:
            return self.word(piece)
        if (mark := self.marks.get(piece[-1])) is not None and (word := piece[:-1]).isalpha() and max(word) < _COMMON_END:
            return self.word(word) + mark
        packed = self.plain(" " + piece)
        return packed if piece[-1].isspace() else self.keep(piece, packed)

    def plain(self, text: str) -> bytes:
        out = []
        for x in self.pretokens(text):
            if x[0] == " " and (word := x[1:]).isalpha() and max(word) < _COMMON_END:
                out.append(self.word(word))
            else:
                packed = self.tokens.get(x)
                if packed is None:
                    packed = self.token(x)
                    if len(x) <= 64:
                        if len(self.tokens) >= CACHE_ENTRIES:
                            self.tokens.clear()
                        self.tokens[x] = packed
                out.append(packed)
        return b"".join(out)

    def part(self, text: str) -> bytes:
        """Ids of a text without special strings. A space after a non-space always starts a
        pre-token, so the text falls into pieces there; with other spacing it is split whole."""
        pieces = text.split(" ")
        if len(pieces) == 1 or (pieces[0] and pieces[0][-1].isspace()):
            return self.plain(text)
        found = list(map(self.pieces.get, pieces))
        found[0] = self.plain(pieces[0])
        if None in found:
            final, older = len(pieces) - 1, self.older.get
            for i, packed in enumerate(found):
                if packed is None:
                    piece = pieces[i]
                    if (packed := older(piece)) is not None:
                        found[i] = self.keep(piece, packed)
                        continue
                    if not piece or (piece[-1].isspace() and i < final):
                        return self.plain(text)
                    found[i] = self.spaced(piece)
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special is None or not any(n in text for n in self.special_names):
            return self.part(text)
        ids = self.vocabulary.specials
        return b"".join(pack([ids[x]]) if x in ids else self.part(x) for x in self.special.split(text) if x)

    def decode(self, packed: bytes | None) -> str:
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _encoder(spec) -> Encoder:
    """The worker's encoder of a broadcast vocabulary; kept between tasks of the worker."""
    return kept(("bpe", hash(spec.value)), lambda: Encoder(spec.value))


def _spec(spark, vocabulary_path: str):
    """The vocabulary file (a few MB, fixed by the tokenizer, not by the data), sent to workers."""
    bounded_batches(spark)
    with open(vocabulary_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """df with a BINARY column of the packed ids of its text."""
    spec = _spec(df.sparkSession, vocabulary_path)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        one = _encoder(spec).encode
        return pa.array([one(x) for x in texts.to_pylist()], pa.binary())

    return df.withColumn(to, ids(F.col(text).cast("string")))


def decode(df: DataFrame, vocabulary_path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """df with the text that its packed ids stand for; broken UTF-8 becomes U+FFFD."""
    spec = _spec(df.sparkSession, vocabulary_path)

    @F.arrow_udf("string")
    def texts(packed: pa.Array) -> pa.Array:
        one = _encoder(spec).decode
        return pa.array([one(x) for x in packed.to_pylist()], pa.string())

    return df.withColumn(to, texts(F.col(ids)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from them."""
    path = vocabulary_path or default_vocabulary()
    both = decode(encode(docs.select("doc_id", "text"), path), path)
    return both.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("token_ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
