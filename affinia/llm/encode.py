"""Exact byte-level BPE encoding by the tokenizers library, with a bounded memory of encoded chunks.

A byte-level BPE first cuts a text into pre-tokens, and no merge crosses them. Some of these cuts are plain:
before a single space between two characters that are no white space, around a single line feed between
two such, and between a letter and the marks that end a chunk. So the text is cut there, each distinct chunk
is encoded once by the library, and the ids of the chunks are joined. A chunk of plain letters is one
pre-token and goes straight to the library's BPE model. Anything else, with any other white space inside, is
left to the library as a whole.
"""

from __future__ import annotations

import ctypes
import os
import re
import struct
import sys
import weakref
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from affinia.llm.common import releases

_ODD_SPACE = re.compile(r"\s\s|\s\Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Marks that are neither letter, number nor white space, and begin no contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_{|}~"
#: Below this, which characters are letters is the same in all versions of Unicode.
_SETTLED = "Ԁ"


class _Memory(dict):
    """Ids of chunks, in two generations; ``lead`` is what stands before each."""

    def __init__(self, owner: Encoder, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.owner.fresh(self.lead, chunk)
        if len(chunk) <= self.owner.longest:
            if len(self) >= self.owner.entries:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts into little-endian unsigned 32-bit ids; a null text has none.

    Strings of special tokens in a text are ordinary text. The memory has two generations of ``entries``
    chunks at most; chunks longer than ``longest`` are not kept.
    """

    def __init__(self, path: str, entries: int = 400_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        pre = self.tokenizer.pre_tokenizer
        self.model = self.tokenizer.model
        self.cut = isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None and isinstance(self.model, BPE)
        self.entries, self.longest = entries, longest
        self.first, self.spaced = _Memory(self, ""), _Memory(self, " ")
        # the byte-level alphabet: printable bytes stand for themselves, others for characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.space = self.letters[32]

    def forget(self) -> None:
        """Empty the memory."""
        for memory in (self.first, self.spaced):
            memory.clear()
            memory.old = {}

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    if sys.byteorder == "little":

        @staticmethod
        def _bytes(ids: list[int]) -> bytes:
            return array("I", ids).tobytes()

    else:

        @staticmethod
        def _bytes(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

    def _library(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def fresh(self, lead: str, chunk: str) -> bytes:
        """Ids of lead + chunk."""
        if chunk.isalpha():
            if chunk.isascii():
                return self._bytes([x.id for x in self.model.tokenize(self.space + chunk if lead else chunk)])
            if max(chunk) < _SETTLED:
                pre = (lead + chunk).encode().decode("latin-1").translate(self.letters)
                return self._bytes([x.id for x in self.model.tokenize(pre)])
            return self._library(lead + chunk)
        memory = self.spaced if lead else self.first
        if "\n" in chunk and chunk[0] != "\n" and not _ODD_SPACE.search(chunk):
            one, *lines = chunk.split("\n")
            feed = self.first["\n"]
            return memory[one] + b"".join([feed + self.first[x] for x in lines])
        stem = chunk.rstrip(_MARKS)
        if len(stem) < len(chunk) and stem and stem[-1].isalpha() and stem[-1] < _SETTLED:
            return memory[stem] + self.first[chunk[len(stem) :]]
        return self._library(lead + chunk)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        if not self.cut:
            return np.frombuffer(self._library(text), "<u4")
        first, *rest = _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        return np.frombuffer((self.first[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest)), "<u4")

    def encode_many(self, texts: list[str | None], characters: int = 1 << 22) -> Iterator[np.ndarray]:
        """Ids of each text, in order. Texts are taken in runs of about so many characters; the distinct
        words of a run are looked up once, and arrow and numpy put the ids together."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= characters):
                size += len(texts[end] or "")
                end += 1
            yield from self._run(texts[at:end])
            at = end

    def _run(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = [k for k, x in enumerate(texts) if self.cut and x and not _ODD_SPACE.search(x)]
        for k in set(range(len(texts))) - set(plain):
            out[k] = self.encode(texts[k])
        if not plain:
            return out
        lists = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
        words, offsets = lists.flatten(), lists.offsets.to_numpy()
        # each word as a stem and the marks at its end, where these follow an ASCII letter
        _, ends, data = words.buffers()
        ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
        stems = pc.binary_length(pc.utf8_rtrim(words, characters=_MARKS)).to_numpy()
        last = np.frombuffer(data, np.uint8)[np.maximum(ends[:-1] + stems - 1, 0)] | 32
        stems = np.where((stems > 0) & (last >= 97) & (last <= 122), stems, np.diff(ends))
        parts = np.empty(2 * len(words) + 1, np.int64)
        parts[::2], parts[1::2] = ends, ends[:-1] + stems
        coded = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(parts), data).dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        known = coded.dictionary.to_pylist()
        ids = [b""] * (2 * len(known))
        leads = 2 * offsets[:-1]
        first = at[leads]
        at[leads] = 2 * len(known) + np.arange(len(plain))
        for k in np.unique(np.delete(at[::2], offsets[:-1])).tolist():
            ids[k] = self.spaced[known[k]]
        for k in np.unique(at[1::2]).tolist():
            ids[len(known) + k] = self.first[known[k]]
        at[1::2] += len(known)
        ids += [self.first[known[k]] for k in first.tolist()]
        pool = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        begins = np.cumsum(lengths, dtype=np.int32) - lengths
        own = lengths[at]
        ends = np.cumsum(own, dtype=np.int64)
        got = pool[np.repeat(begins[at] - (ends - own).astype(np.int32), own) + np.arange(int(ends[-1]), dtype=np.int32)]
        cuts = np.concatenate([[0], ends])[2 * offsets]
        for k, a, z in zip(plain, cuts, cuts[1:], strict=False):
            out[k] = got[a:z]
        return out


#: The encoders of this process.
_CODERS: weakref.WeakSet = weakref.WeakSet()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a process and file: a worker's memory outlives its tasks, until ``release``."""
    coder = Encoder(path)
    _CODERS.add(coder)
    return coder


def _forget() -> None:
    held = [coder for coder in _CODERS if coder.first or coder.spaced]
    for coder in held:
        coder.forget()
    if held:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed
            trim(0)


releases(_forget)
