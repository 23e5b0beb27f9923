"""Whole-text encoding with the tokenizers library, remembering the ids of text pieces.

Both public vocabularies split a text at a space or line feed that stands alone between other characters, whatever
surrounds it, so a text's ids are those of its pieces in order. Texts that don't split this way (two spaces in a row,
other white space at a piece's edge, the start of a special token) are encoded whole. A batch's pieces are dictionary-encoded
by Arrow, so only its distinct pieces are looked up, and the ids are put together by offsets. A piece of Latin letters is one
word of the model under either vocabulary's rules, as are the marks behind it, and goes to the model directly.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import let_go

#: Pieces remembered by each Python worker, about 200 bytes each; beyond that, the later half of them is forgotten, as what is
#: frequent came early.
REMEMBER = 1_300_000
#: Bytes of text that are split at a time; a longer text stands alone.
AT_ONCE = 4 << 20

_LATIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")
_PLAIN = re.compile(r" ?\S(?:.*\S)?", re.DOTALL)
WHOLE, NONE = 0, 1


class Encoder:
    """The unsigned 32-bit ids of texts, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        # a separator with an id of its own, for encoding many pieces in one call
        self.keeps_space = len(self._encode(" a")) != len(self._encode("a")) or self._encode(" a").tolist() != self._encode("a").tolist()
        self.separator = "\n" if self.keeps_space else " | "
        one = self._encode(self.separator)
        self.mark = int(one[0]) if len(one) == 1 else None
        self.release()
        # letters and marks may go to the model alone if that gives what the whole tokenizer does
        self.model, self.lowers = self.tokenizer.model, self._encode("A").tolist() == self._encode("a").tolist()
        self.byte_names = _byte_names()
        self.space, self.tokenize = self.byte_names[0x20], self.model.tokenize
        self.by_model = all(self._model_ids(t) == self._encode(t).tolist() for t in ("hello", "Over", "déjà", "Straße", ".", "?!", "zqxj", *([" hello", " Ünder"] if self.keeps_space else [])))

    def release(self) -> None:
        """Forget all pieces. Slots: WHOLE for those that send their text to the library whole, NONE for the empty piece."""
        self.known: dict[str, int] = {"": WHOLE if self.keeps_space else NONE}
        self.start, self.length, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 2
        self.ids_, self.filled = np.empty(1 << 18, np.uint32), 0
        self.marks: dict[str, list[int]] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _model_ids(self, word: str) -> list[int]:
        """The ids of a run of letters or of marks, with a space before it where the vocabulary keeps spaces."""
        if self.lowers:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.byte_names)
        elif word[0] == " ":
            word = self.space + word[1:]
        return [t.id for t in self.tokenize(word)]

    def _by_model(self, piece: str) -> list[int] | None:
        """The ids of a piece of Latin letters, and marks behind them; None for other pieces."""
        m = _LATIN.fullmatch(piece)
        if m is None or "\u0130" in piece:
            return None
        word, marks = m.groups()
        if not marks:
            return self._model_ids(word)
        if marks not in self.marks and len(self.marks) < 10_000:
            self.marks[marks] = self._model_ids(marks)
        return self._model_ids(word) + (self.marks.get(marks) or self._model_ids(marks))

    def _store(self, raw: np.ndarray) -> int:
        """Append ids; returns where they begin."""
        at, self.filled = self.filled, self.filled + len(raw)
        if self.filled > len(self.ids_):
            self.ids_ = np.concatenate([self.ids_[:at], np.empty(max(at, len(raw)) * 2, np.uint32)])
        self.ids_[at : self.filled] = raw
        return at

    def _add(self, pieces: list[str], lengths: np.ndarray, raw: np.ndarray) -> None:
        """Give pieces, whose ids follow each other in raw, the next slots."""
        at, first = self._store(raw), self.used
        self.used += len(pieces)
        if self.used > len(self.start):
            more = np.zeros(self.used, np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        self.length[first : self.used] = lengths
        self.start[first : self.used] = at + np.cumsum(lengths) - lengths
        self.known.update(zip(pieces, range(first, self.used), strict=True))

    def _forget(self) -> None:
        if self.used <= REMEMBER:
            return
        self.used //= 2
        self.known = {k: v for k, v in self.known.items() if v < self.used}
        self.filled = int((self.start[: self.used] + self.length[: self.used]).max())

    def _plain(self, piece: str) -> bool:
        """Whether the piece's ids don't depend on what stands around it."""
        return piece == "\n" or (_PLAIN.fullmatch(piece) is not None and "<|" not in piece)

    def _learn(self, pieces: list[str]) -> None:
        plain, direct, ids = [], [], []
        sep = self.separator.strip(" ")
        for p in pieces:
            own = self._by_model(p) if self.by_model else None
            if own is not None:
                direct.append(p)
                ids.append(own)
            elif not self._plain(p):
                self.known[p] = WHOLE
            elif self.mark is None or sep in p:
                raw = self._encode(p)
                self._add([p], np.array([len(raw)]), raw)
            else:
                plain.append(p)
        self._add(direct, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32))
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            raw = self._encode(self.separator.join(some))
            cuts = np.flatnonzero(raw == self.mark)
            if len(cuts) == len(some) - 1:
                self._add(some, np.diff(np.concatenate([[-1], cuts, [len(raw)]])) - 1, np.delete(raw, cuts))
                continue
            for p in some:
                own = self._encode(p)
                self._add([p], np.array([len(own)]), own)

    def _split(self, texts: pa.Array) -> pa.ListArray:
        if self.keeps_space:
            return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def _encode_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self._forget()
        lists = self._split(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        slot = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(slot < 0)
        if len(new):
            missing = [distinct[i] for i in new]
            self._learn(missing)
            slot[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
        own = slot[pieces.indices.to_numpy()]
        start, length = self.start[own], self.length[own]
        whole = np.add.reduceat(own == WHOLE, bounds[:-1]) > 0  # each text has a piece at least
        if self.keeps_space:
            whole |= pc.greater_equal(pc.find_substring(texts, "\0"), 0).to_numpy(zero_copy_only=False)
        kept = self.filled
        for k in np.flatnonzero(whole).tolist():
            raw = self._encode(texts[k].as_py())
            length[bounds[k] : bounds[k + 1]] = 0
            length[bounds[k]], start[bounds[k]] = len(raw), self._store(raw)
        ends = np.concatenate([[0], np.cumsum(length)])
        out = self.ids_[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
        self.filled = kept
        return out, np.diff(ends[bounds])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, edges): text k's ids are ids[edges[k]:edges[k + 1]], with the end id if one
        is given. Null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))])
        parts, counts, at = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(size, size[at] + AT_ONCE, "right")) - 1)
            ids, n = self._encode_some(pa.concat_arrays([texts.slice(at, upto - at)]))
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            parts.append(ids)
            counts.append(n)
            at = upto
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, little-endian."""
        out, edges = self.encode(pa.array(texts, pa.string()))
        return [out[a:z].astype("<u4").tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _byte_names() -> dict[int, str]:
    """The character by which byte-level vocabularies name a byte: printable ones of Latin-1 themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = AT_ONCE) -> Iterator[pa.Table]:
    """Batches joined until their column holds about `size` bytes, since larger batches repeat more of their pieces.

    At the end, when a task has no more to encode, its worker's encoders forget their pieces: an idle worker would hold them
    through all later stages.
    """
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(column).nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
            let_go()
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    for e in _ENCODERS.values():
        e.release()
    let_go()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
