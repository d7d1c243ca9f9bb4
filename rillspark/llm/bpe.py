"""Byte-level BPE by a prefix-sharing traversal of a trie of distinct words.

The encoding of a word's prefix is given by its last token and the encoding of what stands before that token. So it is enough to
keep, for each place of a word, the last token of the encoding that ends there (its state). The distinct words of a batch, in
sorted order, are the depth-first order of their trie, and the stack of states is the path from its root: a word starts from the
states of the prefix that it shares with the word before, which are computed once.

A token can end a prefix if it is a suffix of it and if BPE, run on the last token before and on this one together, would merge
nothing across their border. Exactly one token can, for each prefix (checked against the library in the tests).

Which tokens are suffixes of a prefix is told by an automaton over the vocabulary: its state at a place is the longest suffix there that begins a
token. Its steps are worked out when they first occur; there are no more than the vocabulary has beginnings, times 256.

The vocabulary file is a parameter (a tokenizers JSON file of kind byte-level BPE); only the file's tables are used here, not the
library. Rows with null text count as empty and give no ids; a batch is done in slices of whole texts, so memory grows with the longest
text only; rows with the same id are done each for itself; an id may be null or of any type; an empty table gives an empty result; other columns are left alone, and columns of the names of the results are not
read. The tables of pieces that a worker keeps are bounded (MOST_PIECES).
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import slices

#: A worker forgets its pieces (words with the space before) and states beyond this number; they are computed again when needed.
MOST_PIECES = 400_000
#: Text of a slice, whose distinct words make one trie.
SLICE_BYTES = 4_000_000

# The split pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space other than a space and a line feed, and pairs of these two; a text with any of them is cut with more care.
_ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_UNEVEN = (*_ODD_SPACES, "  ", " \n", "\n ", "\n\n")
_UNEVEN_ASCII = tuple(x for x in _UNEVEN if x.isascii())
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def vocabulary_path() -> str:
    """The vocabulary of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable() -> dict[str, int]:
    """The character that stands for each byte in the file: itself if printable, else the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """The tables of one vocabulary file, and what this worker has encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        to_byte = _printable()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        as_bytes = {text: bytes(to_byte[c] for c in text) for text in file["model"]["vocab"] if text not in self.special}
        self.ids = {as_bytes[text]: i for text, i in file["model"]["vocab"].items() if text not in self.special}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.rank: dict[tuple[int, int], int] = {}  # of the merge of two tokens
        self.halves: dict[int, tuple[int, int, int]] = {}  # token -> rank of its merge, left, right
        for rank, merge in enumerate(file["model"]["merges"]):
            left, right = (as_bytes[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            pair = self.ids[left], self.ids[right]
            self.rank[pair] = rank
            self.halves.setdefault(self.ids[left + right], (rank, *pair))
        #: the automaton: beginnings of tokens, its steps (state << 8 | byte -> state), and per state the tokens that end there, longest first
        self.begins = [b"", *sorted({token[:n] for token in self.ids for n in range(1, len(token) + 1)})]
        self.state = {text: k for k, text in enumerate(self.begins)}
        self.steps: dict[int, int] = {}
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(self.begins)
        self.split = regex.compile(PATTERN)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        texts = [b""] * self.size
        for token, i in [*self.ids.items(), *((k.encode(), i) for k, i in self.special.items())]:
            texts[i] = token
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.token_length = np.array([len(t) for t in texts], np.int64)
        self.lengths = self.token_length.tolist()
        self.token_start = np.r_[0, np.cumsum(self.token_length)[:-1]]
        self.decimal = [b"%d," % i for i in range(self.size)]
        self.packed = [i.to_bytes(4, "little") for i in range(self.size)]
        self.fits: dict[int, bool] = {}
        #: of the pieces known: their ids (little-endian, 32 bits each), and the same in decimal with a comma after each
        self.pieces: dict[str, bytes] = {}
        self.decimals: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between the adjacent tokens a and b unmerged."""
        known = self.fits.get(a << 32 | b)
        if known is not None:
            return known
        # Undo the merges next to the border, latest first; a merge across it would have won if it ranks before the one undone.
        left, right, undone = a, b, 1 << 60
        none = (-1, 0, 0)
        good = True
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < undone:
                good = False
                break
            of_left, of_right = self.halves.get(left, none), self.halves.get(right, none)
            if of_left[0] < 0 and of_right[0] < 0:
                break
            if of_left[0] > of_right[0]:
                undone, left = of_left[0], of_left[2]
            else:  # at equal rank the left one of two equal merges comes first, so the border must not merge at that rank either
                undone, right = of_right[0] + 1, of_right[1]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a << 32 | b] = good
        return good

    def _step(self, key: int) -> int:
        """The state after a state and a byte: the longest suffix that begins a token."""
        text = self.begins[key >> 8] + bytes([key & 255])
        while text not in self.state:
            text = text[1:]
        found = self.steps[key] = self.state[text]
        self.ending[found] = tuple((self.ids[text[k:]], len(text) - k) for k in range(len(text)) if text[k:] in self.ids)
        return found

    def encode_words(self, words: Iterable[bytes]) -> tuple[dict[bytes, bytes], dict[bytes, bytes]]:
        """The ids of each distinct word (packed, and in decimal), by a depth-first walk through the trie of the words."""
        fits, stays_apart, steps, ending = self.fits, self.stays_apart, self.steps, self.ending
        length, packed, decimal = self.lengths, self.packed.__getitem__, self.decimal.__getitem__
        codes: dict[bytes, bytes] = {}
        decimals: dict[bytes, bytes] = {}
        before, token, states = b"", [-1], [0]  # per place: the last token of the prefix that ends there, and the automaton's state
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del token[shared + 1 :], states[shared + 1 :]
            state, end = states[shared], shared
            for byte in word[shared:]:
                end += 1
                try:
                    state = steps[state << 8 | byte]
                except KeyError:
                    state = self._step(state << 8 | byte)
                for t, n in ending[state]:
                    last = token[end - n]
                    if last < 0:
                        break
                    good = fits.get(last << 32 | t)
                    if good if good is not None else stays_apart(last, t):
                        break
                token.append(t)
                states.append(state)
            found, at = [], len(word)
            while at:
                t = token[at]
                found.append(t)
                at -= length[t]
            found.reverse()
            codes[word] = b"".join(map(packed, found))
            decimals[word] = b"".join(map(decimal, found))
            before = word
        return codes, decimals

    def learn(self, pieces: Iterable[str]) -> None:
        """Make the pieces known: all of them are in `pieces` afterwards.

        Beyond MOST_PIECES, what is known becomes the older half; from there a piece is taken back when it occurs again, so that
        frequent pieces stay and memory is bounded.
        """
        if len(self.pieces) > MOST_PIECES:
            self.older, self.pieces, self.decimals = (self.pieces, self.decimals), {}, {}
        known, decimals = self.pieces, self.decimals
        unknown = set(pieces).difference(known)
        again = unknown.intersection(self.older[0])
        for table, old in ((known, self.older[0]), (decimals, self.older[1])):
            table.update((p, old[p]) for p in again)
        new = list(unknown - again)
        if not new:
            return
        # a space and letters are one word of the pattern; anything else is split by it
        single = [p[1:].isalpha() and p[0] == " " for p in new]
        words = [p.encode() if one else [w.encode() for w in self.split.findall(p)] for p, one in zip(new, single, strict=True)]
        coded, shown = self.encode_words({w for ws, one in zip(words, single, strict=True) for w in ((ws,) if one else ws)})
        for piece, own, one in zip(new, words, single, strict=True):
            known[piece] = coded[own] if one else b"".join(map(coded.__getitem__, own))
            decimals[piece] = shown[own] if one else b"".join(map(shown.__getitem__, own))

    def cut(self, text: str) -> list[str]:
        """Pieces of a text that are encoded independently of each other: a word with the space before it, mostly."""
        if not text:
            return []
        if self.apart is None or not any(s in text for s in self.special):
            return self._cut(text)
        return [p for k, part in enumerate(self.apart.split(text)) if part for p in ([part] if k % 2 else self._cut(part))]

    def _cut(self, text: str) -> list[str]:
        # The pattern puts a single space between two other characters at the start of a word, so a text can be cut there.
        uneven = text[0].isspace() or text[-1].isspace() or any(x in text for x in (_UNEVEN_ASCII if text.isascii() else _UNEVEN))
        first, *rest = _CUT.split(text) if uneven else text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[list[bytes], list[bytes]]]:
        """For each text, the ids of its pieces (little-endian 32-bit) and the same in decimal, a comma after each."""
        cut = [self.cut(t) for t in texts]
        self.learn(set().union(*cut) - self.special.keys())
        for t, i in self.special.items():
            self.pieces[t], self.decimals[t] = self.packed[i], self.decimal[i]
        code, decimal = self.pieces.__getitem__, self.decimals.__getitem__
        for pieces in cut:
            yield list(map(code, pieces)), list(map(decimal, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids; as text, what is not UTF-8 becomes U+FFFD."""
        n = self.token_length[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        shift = np.repeat(self.token_start[ids] - (ends - n), n)
        return self.token_bytes[shift + np.arange(ends[-1])].tobytes()


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """One Bpe per worker and file."""
    return Bpe(path)


def _coded(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, "text", SLICE_BYTES):
            n, ids_sha, text_sha, lists = [], [], [], []
            for codes, decimals in bpe.encode_batch([t or "" for t in batch.column("text").to_pylist()]):
                ids = np.frombuffer(b"".join(codes), "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b"".join(decimals)[:-1]).hexdigest())
                text = bpe.decode(ids)
                text_sha.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
                lists.append(ids.astype(np.int32) if with_ids else None)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids. A map without a shuffle."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_coded(path, with_ids), schema)
    return out.withColumnRenamed("doc_id", id_col)


def decoded(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`rows` with the text of the ids; null ids give null."""

    @F.pandas_udf("string")
    def text(ids):
        bpe = loaded(path)
        return ids.map(lambda x: None if x is None else bpe.decode(np.asarray(x, np.int64)).decode("utf-8", "replace"))

    return rows.withColumn(text_col, text(F.col(ids_col)))
