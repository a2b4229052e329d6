"""Token ids by the ``tokenizers`` library, with one library call for each distinct chunk of text.

Both vocabularies split a text before they merge, and never across the chunk boundaries used here, so the ids of a
text are those of its chunks in a row. A worker keeps the ids of the chunks it has met, up to ``max_chunks`` (some 200
MB); then it forgets those that it met last, as frequent ones come early. That saves most of the merging: words repeat
far more often than texts. A new word is encoded with many others in one call, and a word with punctuation after it is
the two put in a row. Texts that spell a special token, and texts with unusual white space, are encoded in one piece.
"""

from __future__ import annotations

import os
import re
from itertools import islice, repeat

import numpy as np

#: Chunks: a run of non-blank characters with the one blank before it, or blanks, split as byte-level BPE splits them.
LEADING_BLANK = r" ?[^\s]+|\s+(?!\S)|\s+"
#: Chunks: runs of non-blank characters, where the vocabulary drops white space.
NO_BLANK = r"[^ \t\n\r]+"
#: White space on which regular expression libraries differ; texts that hold any are encoded in one piece.
UNUSUAL = "\x1c\x1d\x1e\x1f", "\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x2010)))

#: White space that plain splits wouldn't do justice to, and the character that they use; beside usual white space only.
INTRICATE = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\0")
#: Letters that are one word in any splitting and have lower-case forms of one letter each.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
#: Marks that are one token group after letters: ASCII punctuation without the apostrophe.
MARKS = r"[!-&(-/:-@\[-`{-~]+"

_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


class ChunkEncoder:
    def __init__(self, path: str, pattern: str, max_chunks: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.find = re.compile(pattern).findall
        self.leading = pattern == LEADING_BLANK
        self.split = self._split_leading if self.leading else str.split if pattern == NO_BLANK else self.find
        self.max_chunks = max_chunks
        blank = " " if self.leading else ""
        self.parts = re.compile(f"({blank}{LETTERS})({MARKS})?").fullmatch
        # the ids that begin a word with a blank before it, or else those that end a word
        self.edges = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.edges[i] = token.startswith("\u0120") if self.leading else token.endswith("</w>")
        self.forget(0)

    def in_one_piece(self, text: str) -> bool:
        """Whether the text has white space on which splits differ, or a special token."""
        ascii_marks, others = UNUSUAL
        return any(c in text for c in ascii_marks) or not text.isascii() and any(c in text for c in others) or any(t in text for t in self.special)

    def _split_leading(self, text: str) -> list[str]:
        """The chunks of ``LEADING_BLANK``; where single blanks and line feeds are all the white space, by plain splits."""
        if any(x in text for x in INTRICATE):
            return self.find(text)
        found = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return found[not found[0] : len(found) - (not found[-1])] if len(found) > 1 else found if text else []

    def forget(self, keep: int) -> None:
        """All chunks but the ``keep`` that were met first."""
        slots = dict(islice(self.slots.items(), keep)) if keep else {}
        if not slots:
            self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            self.flat = np.zeros(1 << 18, np.int32)
        self.slots = slots
        self.used = int(self.starts[len(slots) - 1] + self.lengths[len(slots) - 1]) if slots else 0

    def _learn(self, chunks: list[str]) -> None:
        """Keeps the ids of new chunks."""
        tailed, pairs, words, others = [], [], {}, {}
        for chunk in chunks:
            got = self.parts(chunk)
            if got is None:
                others[chunk] = None
                continue
            word, marks = got.groups()
            if marks:
                tailed.append(chunk)
                pairs += word, marks
                if marks not in self.slots:
                    others[marks] = None
            if word not in self.slots:
                words[word] = None
        self._learn_words(list(words))
        self._learn_others(list(others))
        if tailed:
            slots = np.fromiter(map(self.slots.__getitem__, pairs), np.int64, len(pairs))
            self._keep(tailed, self._ids(slots), self.lengths[slots].reshape(-1, 2).sum(axis=1))

    def _learn_words(self, words: list[str]) -> None:
        """Encodes words many in a row: the edges show where each of them begins or ends."""
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            ids = np.array(self.library.encode_batch_fast([("" if self.leading else " ").join(some)], add_special_tokens=False)[0].ids, np.int32)
            edges = np.flatnonzero(self.edges[ids])
            if len(edges) == len(some):
                lengths = np.diff(edges, append=len(ids)) if self.leading else np.diff(edges, prepend=-1)
                self._keep(some, ids, lengths)
            else:
                self._learn_others(some)

    def _learn_others(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 512):
            some = chunks[at : at + 512]
            lists = [got.ids for got in self.library.encode_batch_fast(some, add_special_tokens=False)]
            self._keep(some, np.array([i for ids in lists for i in ids], np.int32), np.array([len(ids) for ids in lists]))

    def _keep(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        slot, end = len(self.slots), self.used + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while slot + len(chunks) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : end] = ids
        self.lengths[slot : slot + len(chunks)] = lengths
        self.starts[slot : slot + len(chunks)] = self.used + np.cumsum(lengths) - lengths
        self.slots.update(zip(chunks, range(slot, slot + len(chunks)), strict=True))
        self.used = end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (int32), and how many each text has."""
        if len(self.slots) > self.max_chunks:
            self.forget(self.max_chunks // 2)
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = [text] if self.in_one_piece(text) else self.split(text)
            counts[i] = len(found)
            chunks += found
        slots = np.fromiter(map(self.slots.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(slots < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(chunks[i] for i in missing)))
            slots[missing] = [self.slots[chunks[i]] for i in missing]
        bounds = np.concatenate([[0], np.cumsum(self.lengths[slots])])[np.concatenate([[0], np.cumsum(counts)])]
        return self._ids(slots), np.diff(bounds)

    def _ids(self, slots: np.ndarray) -> np.ndarray:
        """The ids of these chunks in a row."""
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[slots] - (ends - lengths), lengths) + np.arange(total)]


def encoder(path: str, pattern: str) -> ChunkEncoder:
    """This worker's encoder; it outlives a task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ChunkEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def in_parts(texts: list[str], characters: int = 1 << 20):
    """Yields (first, texts) of about so many characters, so that chunk lists stay small beside long texts."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= characters:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def documents_with_end(coder: ChunkEncoder, texts: list[str], end_id: int):
    """Yields (first, ids, lengths) with ``end_id`` after each text's ids."""
    for first, some in in_parts(texts):
        ids, lengths = coder.encode(some)
        ids = np.insert(ids, np.cumsum(lengths), end_id).astype(np.int32, copy=False)
        yield first, ids, lengths + 1
