"""Public tokenizer files as encoders that live in a Python worker.

A byte-level BPE splits its text with a fixed pattern and encodes every word by itself. So a batch's
pieces between single spaces are told apart in Arrow, the words of those that are new to the worker
are encoded by the library once, and the texts' ids are put together in numpy. That gives the
library's ids at a fraction of its time; a text that the pattern could read differently goes to the
library whole. What a worker remembers lies in Arrow and numpy, some 30 bytes a word, because workers
keep it while they do other work.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Fixed value: the split pattern of byte-level BPE tokenizers, for text without _UNSAFE characters.
PATTERN = re.compile(rf" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
#: Other characters than those of whose classes every Unicode version says the same.
_UNSAFE = re.compile("[^\t\n\r -~¡-ɏ]").search
#: A piece of such text that neither begins nor ends with white space, for RE2.
_PLAIN = r"\A[!-~¡-ɏ](?:[\t\n\r!-~¡-ɏ]*[!-~¡-ɏ])?\z"
#: Pieces and words that a worker remembers at most, and the bytes that each of them is shorter than.
PIECES, WORDS, LONGEST = 450_000, 300_000, 48
#: Bytes of texts, pieces of texts and new pieces that are worked on at once, and words that the library gets at once.
STRETCH, PLACED, LEARNT, SPELLED = 8 << 20, 1 << 19, 1 << 17, 32


def byte_letters() -> dict[int, str]:
    """Latin-1 code point to the printable letter that stands for that byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file and of its library's version: the key of stored counts."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(Path(path).read_bytes() + f"{library} {version(library)}".encode()).hexdigest()


def _stretches(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of STRETCH bytes together, or one longer text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(False).astype(np.int64))
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + STRETCH, "right")))
        yield texts[low:high]
        low = high


def _joined(texts: pa.Array, by: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), by)[0].as_py()


def _placed(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The stretches of flat that begin at start, of these sizes, in a row; PLACED of them at a time."""
    kind = np.int32 if len(flat) < 1 << 31 else np.int64
    for low in range(0, len(start), PLACED):
        n = size[low : low + PLACED]
        ends = np.cumsum(n)
        place = np.repeat((start[low : low + PLACED] - (ends - n)).astype(kind), n)
        place += np.arange(len(place), dtype=kind)
        yield flat[place]


def _in_a_row(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.concatenate([flat[:0], *_placed(flat, start, size)])


class Memory:
    """The ids of some strings. When it would hold more than `most`, it forgets those not asked for since it last did."""

    def __init__(self, most: int, kind: np.dtype) -> None:
        self.most, self.keys = most, pa.array([], pa.string())
        self.size, self.flat, self.asked = np.empty(0, np.int32), np.empty(0, kind), np.empty(0, bool)

    def look(self, keys: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size, start, flat): the ids of each of some distinct keys as a stretch of flat. learn gives (size, flat, kept) of those not known."""
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy()
        new = at < 0
        known = at[~new]
        self.asked[known] = True
        size, start, flat = np.empty(len(at), np.int64), np.empty(len(at), np.int64), self.flat
        size[~new], start[~new] = self.size[known], (np.cumsum(self.size, dtype=np.int64) - self.size)[known]
        if new.any():
            unknown = keys.filter(pa.array(new))
            n, made, kept = learn(unknown)
            begin = np.cumsum(n) - n
            size[new], start[new] = n, begin + len(flat)
            flat = np.concatenate([flat, made])
            kept &= pc.binary_length(unknown).to_numpy() < LONGEST
            self._keep(unknown.filter(pa.array(kept)), n[kept], _in_a_row(made, begin[kept], n[kept]))
        return size, start, flat

    def _keep(self, keys: pa.Array, size: np.ndarray, flat: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.most:
            asked = self.asked
            self.flat = self.flat[np.repeat(asked, self.size)]
            self.keys, self.size, self.asked = self.keys.filter(pa.array(asked)), self.size[asked], np.zeros(int(asked.sum()), bool)
        room = self.most - len(self.keys)
        size = size[:room].astype(np.int32)
        self.keys = pa.concat_arrays([self.keys, keys[:room]])
        self.size, self.flat, self.asked = np.concatenate([self.size, size]), np.concatenate([self.flat, flat[: size.sum()]]), np.concatenate([self.asked, np.zeros(len(size), bool)])


class Encoder:
    """Token ids of texts, without added special tokens; null is empty."""

    def __init__(self, path: str) -> None:
        self.simple, self.special = False, []
        if path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocab = self.library.get_piece_size()
            self.whole = lambda text: self._pack(self.library.encode(text))
        else:
            from tokenizers import Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_file(path)
            self.library.no_padding()
            self.library.no_truncation()
            self.vocab = max(self.library.get_vocab(with_added_tokens=True).values(), default=0) + 1
            self.whole = lambda text: self._pack(self.library.encode(text, add_special_tokens=False).ids)
            said = json.loads(Path(path).read_text())
            before, model = said.get("pre_tokenizer") or {}, said["model"]
            self.simple = (
                said.get("normalizer") is None
                and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
                and model.get("type", "BPE") == "BPE"
                and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
            )
            self.special = [t["content"] for t in said.get("added_tokens", [])]
            self.simple = self.simple and all(c in model["vocab"] for c in byte_letters().values())
            if self.simple:
                self.letters = np.array([ord(c) for _, c in sorted(byte_letters().items())], "<u2")
                between = chr(self.letters[0])  # the letter of byte 0, which no safe text has
                self.speller = Tokenizer(self.library.model)  # the same model on words that are split already
                if any(between in t for t in model["vocab"] if t != between):  # else no merge crosses it
                    self.speller.pre_tokenizer = pre_tokenizers.Split(between, "isolated")
                self.between = self.library.token_to_id(between)
                if hasattr(self.library.model, "_resize_cache"):
                    self.library.model._resize_cache(0)  # its own memory of words costs more than it saves beside this one
        self.width = 2 if self.vocab <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.pieces, self.words = Memory(PIECES, self.kind), Memory(WORDS, self.kind)

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _spelled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size, flat, all true): the ids of some safe words, each with the space before it."""
        made, text = [], self.letters[np.frombuffer(_joined(words, "\0").encode() + b"\0", np.uint8)].tobytes().decode("utf-16-le")
        ends = (np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64)) + np.arange(1, len(words) + 1))[SPELLED - 1 :: SPELLED]
        for a, z in pairwise([0, *ends.tolist(), len(text)]):
            if a < z:
                made.append(self._pack(self.speller.encode_batch_fast([text[a:z]], add_special_tokens=False)[0].ids))
        flat = np.frombuffer(b"".join(made), self.kind)
        between = flat == self.between
        return np.diff(np.flatnonzero(between), prepend=-1) - 1, flat[~between], np.ones(len(words), bool)

    def _worded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size, flat, spaced): the ids of safe words, as often as they stand there, and which of them begin with a space."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        size, start, flat = self.words.look(coded.dictionary, self._spelled)
        code, spaced = coded.indices.to_numpy(), pc.starts_with(coded.dictionary, " ").to_numpy(False)
        return size[code], _in_a_row(flat, start[code], size[code]), spaced[code]

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size, flat, plain): the ids of pieces, a space before each; none for those that can't be told apart from their neighbours."""
        plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(False)
        size, ids = np.zeros(len(pieces), np.int64), []
        for low in range(0, len(pieces), LEARNT):
            safe = plain[low : low + LEARNT]
            if safe.any():
                n, flat, spaced = self._worded(PATTERN.findall(" " + _joined(pieces[low : low + LEARNT].filter(pa.array(safe)), " ")))
                size[low : low + LEARNT][safe] = np.add.reduceat(n, np.flatnonzero(spaced))
                ids.append(flat)
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return size, np.concatenate([np.empty(0, self.kind), *ids]), plain
        for i, p in zip(rest.tolist(), pieces.take(pa.array(rest)).to_numpy(False).tolist(), strict=True):
            if p and not (p[0].isspace() or p[-1].isspace()):
                ids.append(np.frombuffer(self.whole(" " + p), self.kind))
                size[i] = len(ids[-1])
        there = np.r_[np.flatnonzero(plain), rest]  # in the order of ids
        start = np.empty(len(size), np.int64)
        start[there] = np.cumsum(size[there]) - size[there]
        return size, _in_a_row(np.concatenate([np.empty(0, self.kind), *ids]), start, size), plain

    def _firsts(self, texts: pa.Array, heads: list[str], apart: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text's first piece, or of the whole text if it isn't apart; and all of these ids in a row."""
        words, counts, whole = [], [], {}
        for i, (head, a) in enumerate(zip(heads, apart, strict=True)):
            safe = a and not _UNSAFE(head)
            if not safe:
                whole[i] = np.frombuffer(self.whole(head if a else texts[i].as_py()), self.kind)
            found = PATTERN.findall(head) if safe else []
            words += found
            counts.append(len(found))
        n, flat, _ = self._worded(words)
        upto = np.cumsum(np.r_[0, n])[np.cumsum([0, *counts])]
        size = np.diff(upto)
        if whole:
            parts, done = [], 0
            for i, ids in whole.items():
                parts += [flat[done : upto[i]], ids]
                done, size[i] = upto[i], len(ids)
            flat = np.concatenate([*parts, flat[done:]])
        return size, flat

    def _stretch(self, texts: pa.Array, lengths: list[np.ndarray], ids: list[np.ndarray] | None) -> None:
        lists = pc.split_pattern(texts, " ")
        head = lists.offsets.to_numpy()[:-1].astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        code, pieces = coded.indices.to_numpy().copy(), coded.dictionary
        size, start, flat = self.pieces.look(pieces, self._learn)
        odd = size == 0
        apart = ~np.logical_or.reduceat(odd[code], head) if odd.any() else np.ones(len(head), bool)
        for s in self.special:
            apart &= ~pc.match_substring(texts, s).to_numpy(False)
        n, firsts = self._firsts(texts, pieces.take(pa.array(code[head])).to_numpy(False).tolist(), apart.tolist())
        if not apart.all():
            code[~np.repeat(apart, np.diff(np.r_[head, len(code)]))] = len(pieces)  # in a text that went whole, all but the first piece are empty
        code[head] = len(pieces) + 1 + np.arange(len(head))
        size, start = np.r_[size, 0, n], np.r_[start, 0, len(flat) + np.cumsum(n) - n]
        each = size[code]
        lengths.append(np.add.reduceat(each, head))
        if ids is not None:
            ids.extend(_placed(np.concatenate([flat, firsts]), start[code], each))

    def batch(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids in a row (none with ids=False)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lengths, made = [np.empty(0, np.int64)], [np.empty(0, self.kind)]
        if self.simple:
            for some in _stretches(texts):
                self._stretch(some, lengths, made if ids else None)
        else:
            for t in texts.to_pylist():
                made.append(np.frombuffer(self.whole(t), self.kind))
            lengths = [np.array([len(m) for m in made[1:]], np.int64)]
        return np.concatenate(lengths), np.concatenate(made)

    def ids(self, text: str | None) -> bytes:
        return self.batch(pa.array([text], pa.string()))[1].tobytes()

    def count(self, text: str | None) -> int:
        return int(self.batch(pa.array([text], pa.string()), ids=False)[0][0])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)
