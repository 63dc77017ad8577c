"""Token ids of whole texts, fast: each distinct word is tokenized once per worker.

Both vocabularies split a text before they merge bytes, and never across a
place where white space follows other characters. So the ids of a text are the
ids of its words in a row. Words come from Arrow kernels, known words from a
bounded cache, and only new ones go to the tokenizers library. Texts in which
cutting at white space isn't proven safe, and texts that spell out an added
token (such as <|endoftext|>), are given to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that the words held per worker may take, some 160 beside a word's own; beyond, the cache starts anew.
CACHE_BYTES, WORD_BYTES = 224 << 20, 160
#: White space other than blank and line feed: such texts go to the library whole.
ODD_SPACE = r"[\t\r\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STOPS = (",", ".")
LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))


class WordEncoder:
    """keeps_space: a word's leading blank is part of its first token (byte-level BPE)."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.added = "(?i)" + "|".join(re.sub(r"([^\w\s])", r"\\\1", a) for a in added) if added else None
        self.keeps_space = keeps_space
        #: No text that is cut holds a carriage return (ODD_SPACE); words rarely hold the control character.
        self.mark = "\r" if keeps_space else "\x01"
        (self.mark_id,) = self._library([self.mark])[0]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0
        self.held = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids by word), many words in one call.

        A mark that is a token of its own and that no neighbour joins stands
        after each word; words that contain it are encoded by themselves.
        """
        if any(self.mark in w for w in words):
            lists = self._library(words)
            return np.asarray([i for x in lists for i in x], np.uint32), np.asarray([len(x) for x in lists], np.int64)
        between = self.mark if self.keeps_space else f" {self.mark} "
        step = 1024
        lists = self._library([between.join([*words[i : i + step], ""]) for i in range(0, len(words), step)])
        ids = np.concatenate([np.asarray(x, np.uint32) for x in lists])
        marks = np.flatnonzero(ids == self.mark_id)
        if len(marks) != len(words):
            raise ValueError("the mark isn't a token of its own in this vocabulary")
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, known = len(self.known), self.known
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.held += sum(map(len, words)) + WORD_BYTES * len(words)
        known.update(zip(words, range(n, n + len(words)), strict=True))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers in a row, and the number of ids by word."""
        begin = self.starts[numbers]
        lengths = self.starts[numbers + 1] - begin
        ends = np.cumsum(lengths)
        return self.pool[np.repeat(begin - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Place of each (distinct) word in the cache; new words are tokenized.

        A comma or stop after a Latin letter is a piece of its own in both
        vocabularies, so only the word before it has to be tokenized.
        """
        known = self.known
        got = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(got < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            ends, whole = [], []
            for w in new:
                (ends if w[-1:] in STOPS and w[-2:-1] in LATIN and w[-2:-1] else whole).append(w)
            stems = [w[:-1] for w in ends]
            ask = list(dict.fromkeys([*whole, *(w for w in (*stems, *STOPS) if w not in known)]))
            if ask:
                self._add(ask, *self._joined(ask))
            if ends:
                pairs = np.empty(2 * len(ends), np.int64)
                pairs[::2] = [known[w] for w in stems]
                pairs[1::2] = [known[w[-1]] for w in ends]
                ids, lengths = self._gather(pairs)
                self._add(ends, ids, lengths[::2] + lengths[1::2])
            got[missing] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        return got

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ends by text: one more than texts, from 0)."""
        if self.held > CACHE_BYTES:
            self.clear()
        n = len(texts)
        if self.keeps_space:
            ready = pc.replace_substring(texts, "\n", " \n")
        else:  # the vocabulary has lower case only and drops white space
            ready = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        lists = pc.split_pattern(ready, " ")
        ends = np.asarray(lists.offsets, dtype=np.int64)
        ends = ends - ends[0]
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        whole: dict[int, list[int]] = {}
        odd = np.zeros(n, bool)
        if self.added:
            odd = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        if self.keeps_space:
            odd = odd | pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
            odd_words = pc.is_in(words, pa.array(["", "\n"], words.type)).to_numpy(zero_copy_only=False)
            if odd_words.any():
                bad_sum = np.concatenate([[0], np.cumsum(odd_words[index])])
                odd = odd | (bad_sum[ends[1:]] > bad_sum[ends[:-1]])
            firsts = ends[:-1][ends[1:] > ends[:-1]]
            first_words = flat.take(pa.array(firsts)).to_pylist()
            spaced = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type)))
            numbers = self._numbers(spaced.to_pylist())[index]
            distinct = dict.fromkeys(first_words)
            at = dict(zip(distinct, self._numbers(list(distinct)), strict=True))
            numbers[firsts] = [at[w] for w in first_words]
        else:
            numbers = self._numbers(words.to_pylist())[index]
        odd_rows = np.flatnonzero(odd)
        if len(odd_rows):
            whole = dict(zip(odd_rows.tolist(), self._library([texts[int(i)].as_py() for i in odd_rows]), strict=True))
        begin = self.starts[numbers]
        numbers += 1
        length = self.starts[numbers] - begin
        for i in whole:  # their own ids come below
            length[ends[i] : ends[i + 1]] = 0
        placed = np.concatenate([[0], np.cumsum(length)])
        narrow = np.int32 if max(int(placed[-1]), self.used) < 1 << 31 else np.int64
        ids = self.pool.take(np.repeat((begin - placed[:-1]).astype(narrow), length) + np.arange(placed[-1], dtype=narrow))
        out = placed[ends]
        if whole:
            parts, sizes = [], np.diff(out)
            for i in range(n):
                if i in whole:
                    parts.append(np.asarray(whole[i], np.uint32))
                    sizes[i] = len(whole[i])
                else:
                    parts.append(ids[out[i] : out[i + 1]])
            ids = np.concatenate(parts) if parts else ids
            out = np.concatenate([[0], np.cumsum(sizes)])
        return ids, out


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """One encoder, and so one cache, per worker process."""
    key = (path, keeps_space)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, keeps_space)
    return _encoders[key]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
