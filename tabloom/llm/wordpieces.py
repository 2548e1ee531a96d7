"""Piece ids of words by a public tokenizer, kept in a bounded table inside a task.

The tokenizer's pre-tokens never reach over ASCII white space, so a text's ids are the ids of
its white-space words in order. Words repeat, so each distinct word is encoded once and its ids
are kept in one pool; a text becomes an array of word numbers, and lengths and ids are gathered
from the pool. ``needs_split`` refuses tokenizers for which this does not hold.

Where the tokenizer lower-cases and parts letters from marks itself, texts are put in lower case
and words cut before their marks first: ``Word``, ``word,`` and ``word`` are learnt once. Cutting,
numbering and gathering run over the bytes of many texts at once.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from tabloom.llm.common import worker_table

#: Bytes of texts whose new words are learnt together.
AT_ONCE = 2 << 20
#: The rule by which the tokenizer parts letters, single digits and marks.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters A-Z and those of Latin-1, or marks of ASCII punctuation but the apostrophe: one pre-token.
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+")
#: What a byte is: white space, an ASCII letter or digit, one of those marks, or another byte.
_BLANK, _ALNUM, _MARK, _OTHER = range(4)
#: First bytes of the combining marks that normalization may join to a letter before them.
_COMBINING = (b"\xcc", b"\xcd")
#: Words kept by a task; the table starts anew when it has outgrown this between batches.
KEPT_WORDS = 1_000_000


def _byte_level() -> str:
    """The characters that stand for the bytes: itself if it is printable, else one of those from
    256 on. The line feed, which parts words here, stands for itself."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}
    return "".join(chr(b if b == 0x0A else hidden.get(b, b)) for b in range(256))


def _kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    for b in range(128):
        kinds[b] = _ALNUM if chr(b).isalnum() else _MARK if _PLAIN.fullmatch(bytes([b])) else _BLANK if bytes([b]).isspace() else _OTHER
    return kinds


_BYTE_LEVEL, _KINDS = _byte_level(), _kinds()
#: Second bytes of the letters of Latin-1.
_LATIN = np.array([_PLAIN.fullmatch(bytes([0xC3, b])) is not None for b in range(256)])


def needs_split(path: str) -> None:
    """Raises unless the tokenizer treats white-space words one by one."""
    spec = json.load(open(path, encoding="utf-8"))
    split = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]]
    # the kept pieces of the split: none may hold white space
    if not split or any(re.search(r"\\s(?![^\[]*\])| ", p["pattern"].get("Regex", " ")) for p in split) or any(
        a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in spec["added_tokens"]
    ):
        raise ValueError(f"{path}: its tokens may reach over white space")


class WordPieces:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        needs_split(path)
        spec = json.load(open(path, encoding="utf-8"))
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]] == ["Split", "ByteLevel"] and not any(a["normalized"] for a in spec["added_tokens"])
        # whether a word of letters is its own pre-token once it is in lower case, and a mark after a letter begins one
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and split and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": _PARTS}
        self.added = [a["content"].encode().lower() for a in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, words: Iterable[bytes]) -> None:
        """Letters, and marks of punctuation, are lower-cased and go to the model itself: they are
        one pre-token. All other words take the tokenizer's whole way."""
        plain, rest, one = [], [], _PLAIN.fullmatch
        for word in words:
            (plain if self.plain and (word.isalpha() or one(word)) else rest).append(word)
        if plain:
            shown = codecs.charmap_decode(b"\n".join(plain).decode().lower().encode(), "strict", _BYTE_LEVEL)[0]
            ids, counts, tokenize = [], [], self.tokenizer.model.tokenize
            for text in shown.split("\n"):
                got = [t.id for t in tokenize(text)]
                ids += got
                counts.append(len(got))
            self._add(plain, counts, ids)
        self._learn_whole(rest)

    def _add(self, words: list[bytes], counts, ids) -> None:
        k, n = len(self.number), len(words)
        while k + n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.number.update(zip(words, range(k, k + n)))
        self.length[k : k + n] = counts
        self.start[k : k + n] = self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn_whole(self, words: list[bytes]) -> None:
        """Words are encoded many at a time, parted by blanks; the pieces' offsets tell whose they are."""
        for i in range(0, len(words), 2048):
            part = words[i : i + 2048]
            texts = [w.decode("utf-8", "replace") for w in part]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            starts = np.cumsum(sizes + 1) - sizes - 1
            spans = np.array(got.offsets, np.int64).reshape(-1, 2)
            ids, owner = np.array(got.ids, np.uint32), np.searchsorted(starts, spans[:, 0], "right") - 1
            if len(ids) and ((spans[:, 1] > (starts + sizes)[owner]).any() or (owner[1:] < owner[:-1]).any()):
                each = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
                ids, counts = np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64)
            else:
                counts = np.bincount(owner, minlength=len(part)) if len(ids) else np.zeros(len(part), np.int64)
            self._add(part, counts, ids)

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """The distinct words of the texts, for every place the word that stands there, and each text's first place."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes + 1) - sizes - 1
        if self.plain:
            low = [t.lower() for t in texts]
            # an added token is found as it is written and is not cut
            whole = np.array([any(a in t for a in self.added) for t in low])
            texts = [t if w or any(c in t for c in _COMBINING) else x for t, x, w in zip(texts, low, whole)]
        data = np.frombuffer(b" ".join(texts), np.uint8)
        kinds = _KINDS[data]
        seen = kinds != _BLANK
        first = seen.copy()
        first[1:] &= ~seen[:-1]
        if self.plain:
            mark = kinds == _MARK
            cuts = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1
            cuts = cuts[(kinds[cuts - 1] == _ALNUM) | ((data[cuts - 2] == 0xC3) & _LATIN[data[cuts - 1]])]
            first[cuts[~whole[np.searchsorted(begins, cuts, "right") - 1]] if whole.any() else cuts] = True
        packed, starts = data[seen], np.flatnonzero(first[seen])
        ends = pa.py_buffer(np.append(starts, len(packed)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(packed)]).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist(), np.searchsorted(np.flatnonzero(first), begins)

    def _numbered(self, texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For many texts at once the numbers of their words, and each text's first place in them."""
        for held in _held(texts):
            places, words, firsts = self._words(held)
            fresh = [w for w in words if w not in self.number]
            if fresh:
                if len(self.number) > KEPT_WORDS:
                    self._clear()
                    fresh = words
                self._learn(fresh)
            yield np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[places], firsts

    def numbers(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The words of each text as numbers into ``start`` and ``length``, good until the next text is asked for."""
        for at, firsts in self._numbered(texts):
            yield from np.split(at, firsts[1:])

    def ids(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        for at, firsts in self._numbered(texts):
            lengths = self.length[at]
            ends = np.append(0, np.cumsum(lengths))
            ids = self.pool[np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], lengths)]
            yield from np.split(ids, ends[firsts[1:]])


def _held(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_pieces(path: str) -> WordPieces:
    """One table for each Python worker, kept between its tasks of one operator."""
    return worker_table(path, lambda: WordPieces(path))
