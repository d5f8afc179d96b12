"""Byte-level BPE ids of whole texts: words are found by Arrow kernels, and the library sees each word once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: White space other than the single space and the newline, and the mark of first words: texts with these take the other way.
_ODD = "[\\x00\\x09\\x0b-\\x0d\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
_FIRST = "\x00"


class Codes:
    """Ids of words, remembered as slices of one flat array; a bounded memory of the words met so far.

    Byte-level BPE merges inside the matches of its split pattern only, and a
    match never spans a place where white space follows something else. So a
    text may be cut there and the ids of its pieces joined. Pieces not met
    before are encoded many at a time, joined by the white space that they begin
    with; the ids are cut again before each token that begins with it.
    """

    #: Words remembered, words joined to one text for the library, and words whose ids are gathered at a time.
    LIMIT, JOINED, GATHERED = 500_000, 1000, 1 << 16

    def __init__(self, path: str, added: bool = True, limit: int = LIMIT):
        """With ``added`` the strings of added tokens in a text give the ids of these, as the library does; else they are ordinary text.

        Up to ``limit`` words are remembered.
        """
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        tokens = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        # the byte-level alphabet writes a space and a newline as these letters
        self.begins = {" ": np.array([t[:1] == "Ġ" for t in tokens]), "\n": np.array([t[:1] == "Ċ" for t in tokens])}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.held = np.empty(1 << 20, self.kind), 0
        self.starts, self.sizes = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> None:
        """Remember ``words``, whose ids lie at ``firsts`` of ``ids``."""
        n, at = len(self.known), self.held
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        self.flat[at : at + len(ids)] = ids
        self.held = at + len(ids)
        self.starts[n : n + len(words)], self.sizes[n : n + len(words)] = at + firsts, sizes
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, words: list[str]) -> None:
        """Words begin with the mark of first words, with a newline, or stand for themselves after a space."""
        spaced = [w for w in words if w[:1] not in (_FIRST, "\n")]
        lines = [w for w in words if w[:1] in (_FIRST, "\n")]
        for group, blank, first in ((spaced, " ", ""), (lines, "\n", "")):
            for at in range(0, len(group), self.JOINED):
                some = group[at : at + self.JOINED]
                bodies = some if blank == " " else [w[1:] for w in some]
                found = self.tokenizer.encode_batch_fast([blank + blank.join(bodies)], add_special_tokens=False)[0].ids
                ids = np.array(found, self.kind)
                firsts = np.flatnonzero(self.begins[blank][ids])
                if len(firsts) != len(some):
                    raise ValueError("the tokenizer doesn't split before white space")
                sizes = np.diff(np.append(firsts, len(ids)))
                # a first word is encoded after a newline, which is one token of its own
                skipped = np.fromiter((w[:1] == _FIRST for w in some), np.int64, len(some))
                self._add(some, ids, firsts + skipped, sizes - skipped)

    def _coded(self, words: pa.Array) -> np.ndarray:
        """The number of each word, all of them learned."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known.get
        numbers = np.fromiter((known(w, -1) for w in distinct), np.int64, len(distinct))
        new = np.flatnonzero(numbers < 0)
        if len(self.known) + len(new) > self.limit and self.known:
            self._forget()
            new = np.arange(len(distinct))
        unseen = [distinct[k] for k in new.tolist()]
        self._learn(unseen)
        numbers[new] = np.fromiter(map(self.known.__getitem__, unseen), np.int64, len(new))
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of learned words in a row, and where each word's begin; some words at a time, as a place takes more room than an id."""
        ends = np.append(0, np.cumsum(self.sizes[numbers]))
        ids = np.empty(ends[-1], self.kind)
        for at in range(0, len(numbers), self.GATHERED):
            some = numbers[at : at + self.GATHERED]
            firsts, low, high = ends[at : at + len(some)], ends[at], ends[at + len(some)]
            ids[low:high] = self.flat[np.repeat(self.starts[some] - firsts, self.sizes[some]) + np.arange(low, high)]
        return ids, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (with one more place for the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = self._plain(texts)
        marked = pc.binary_join_element_wise(pa.scalar(_FIRST, pa.large_string()), texts.filter(plain), pa.scalar("", pa.large_string()))
        words = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        numbers = self._coded(words.flatten())
        ids, ends = self._gathered(numbers)
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        if len(bounds) == len(texts) + 1:
            return ids, bounds
        # the others are cut at safe places by a pattern, and put between
        fast, at = plain.to_numpy(zero_copy_only=False), 0
        parts: list[np.ndarray] = []
        for is_fast, text in zip(fast, texts, strict=True):
            if is_fast:
                parts.append(ids[bounds[at] : bounds[at + 1]])
                at += 1
            else:
                parts.append(self._odd(text.as_py()))
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))

    def _odd(self, text: str) -> np.ndarray:
        """Ids of a text with any white space; long ones are cut at safe places."""
        out, start = [], 0
        while start < len(text):
            cut = _SAFE.search(text, start + 50_000) if len(text) - start > 50_000 else None
            end = cut.start() if cut else len(text)
            out.append(self._ids(text[start:end]))
            start = end
        return np.concatenate(out) if out else np.empty(0, self.kind)

    @staticmethod
    def _plain(texts: pa.Array) -> pa.Array:
        """Whether single spaces and newlines between words are all the white space of a text."""
        ends = pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))
        ends = pc.or_(ends, pc.or_(pc.starts_with(texts, "\n"), pc.ends_with(texts, "\n")))
        bad = pc.or_(pc.equal(texts, ""), ends)
        for pair in ("  ", " \n", "\n ", "\n\n"):
            bad = pc.or_(bad, pc.match_substring(texts, pair))
        return pc.invert(pc.or_(bad, pc.match_substring_regex(texts, _ODD)))


@lru_cache(maxsize=2)
def codes(path: str, added: bool = True, limit: int = Codes.LIMIT) -> Codes:
    """The coder of a vocabulary file, built once per Python worker."""
    return Codes(path, added, limit)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text, little-endian, and how many each text then has."""
    sizes = np.diff(bounds) + 1
    flat = np.full(sizes.sum(), end_id, "<u2" if ids.dtype.itemsize == 2 else "<u4")
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(sizes) - 1] = False
    flat[inside] = ids
    return flat, sizes


def chunks(batches: Iterable[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` again, in batches of a bounded number of bytes of a text column, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        for row, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                if row > start:
                    held.append(batch.slice(start, row - start))
                yield _joined(held)
                held, size, start = [], 0, row
            size += n
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]
