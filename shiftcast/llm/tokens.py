"""Token ids of whole texts, a batch at a time.

White space always parts tokens of the word-level BPE used here, so the ids of a
text are those of its words in order.  A batch's words are hashed and made
distinct with numpy; each distinct word is encoded once by the ``tokenizers``
library and kept in a table of the worker process.  Ids equal those of
``Tokenizer.encode(text, add_special_tokens=False)`` on the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from shiftcast.llm.common import EXACT, span_hashes, text_chunks, word_spans

#: Appended to every text.
END_ID = 1
#: Words in a process's table before it is emptied; results don't depend on it.
TABLE_WORDS = 1_500_000
#: Letters whose case and normal form are plain, then ASCII marks that form one run.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)")


class Encoder:
    """Encodes the words of a batch; use :func:`encoder` to share one in a process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.flat = np.full(1, END_ID, np.int32)  # the end marker is at 0

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.int32) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, cores: list[str]) -> list[np.ndarray]:
        """Ids of words made of letters: many joined by blanks in one call, parted at the word-end tokens."""
        out: list[np.ndarray] = []
        for i in range(0, len(cores), 2000):
            part = cores[i:i + 2000]
            ids = self._encode([" ".join(part)])[0]
            cut = np.flatnonzero(self.ends[ids]) + 1
            out += np.split(ids, cut[:-1]) if len(cut) == len(part) else self._encode(part)
        return out

    def _add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        got = [_PLAIN.fullmatch(t) for t in texts]
        cores = {m[1].lower(): None for m in got if m and m[1]}
        core = dict(zip(cores, self._plain(list(cores))))
        marks = {m[2]: None for m in got if m and m[2]}
        mark = dict(zip(marks, self._encode(list(marks))))
        odd = [t for t, m in zip(texts, got) if not m]
        other = dict(zip(odd, self._encode(odd)))
        none = np.zeros(0, np.int32)
        ids = []
        for t, m in zip(texts, got):
            if not m:
                ids.append(other[t])
            elif not m[2]:
                ids.append(core[m[1].lower()])
            else:
                ids.append(np.concatenate((core[m[1].lower()] if m[1] else none, mark[m[2]])))
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, *ids])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, starts)
        self.counts = np.insert(self.counts, at, counts)

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each row ended by ``END_ID``, and the rows' numbers of ids."""
        starts, ends, doc = word_spans(raw, offs)
        h, one, back = np.unique(span_hashes(raw, starts, ends, EXACT), return_index=True, return_inverse=True)
        if len(self.hashes) > TABLE_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        if not known.all():
            new = np.flatnonzero(~known)
            data = raw.tobytes()
            first = one[new]
            self._add(h[new], [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            at = np.searchsorted(self.hashes, h)
        at = at[back]
        # the end marker stands behind each row's words
        stops = np.cumsum(np.bincount(doc, minlength=len(offs) - 1))
        begin = np.insert(self.starts[at], stops, 0)
        count = np.insert(self.counts[at], stops, 1)
        done = np.cumsum(count)
        total = int(done[-1]) if len(done) else 0
        ids = self.flat[np.repeat(begin - (done - count), count) + np.arange(total)]
        rows = np.diff(np.concatenate(([0], done[stops + np.arange(len(stops))])))
        return ids, rows


_SHARED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _SHARED:
        _SHARED.clear()
        _SHARED[path] = Encoder(path)
    return _SHARED[path]


def encode_column(col: pa.Array, path: str):
    """(first row, last row + 1, ids, ids of each row) for pieces of a text column."""
    enc = encoder(path)
    for i, j, raw, offs in text_chunks(col):
        ids, rows = enc.encode(raw, offs)
        yield i, j, ids, rows
