"""Whole texts to ids by the tokenizers library, each distinct word once a worker.

Splitting a text at its spaces and line feeds first gives the same ids as encoding it whole, as long as
the tokenizer's split pattern never lets a match span white space and its normaliser works on either side
of white space alone. That holds for word_bpe_49k.json: NFC, white space to a space, lower case, and the
pattern [letters]+, one digit, [other visible characters]+ or an apostrophe's short forms.

Pieces of ASCII (without apostrophes and what a special token begins with) and of the letters of Latin-1 are also lower-cased and
cut here, by array operations on their bytes: at every change between letters and marks, and at every
digit. Such words are their own normal form, so the library gets them without its normaliser and cuts them at
spaces alone. All other pieces go to it as they are. tests/llm compares both ways.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from scorelake.llm.common import Memo, held
from scorelake.llm.pieces import FEED, LATIN, SPACE, chunks, distinct, put, runs

#: Longer words are encoded but not remembered.
LONGEST_KEPT = 64
MOST_WORDS = 1_000_000
WORD_END = "</w>"
#: What a byte can be. Letters of Latin-1 are the byte LATIN and one of the second half, capitals up to CAPITALS.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
CAPITALS = 0x9E
_KIND = np.full(256, ODD, np.uint8)
_KIND[33:127] = MARK
_KIND[[SPACE, FEED]] = BLANK
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), LATIN]] = LETTER
_KIND[48:58] = DIGIT
_KIND[ord("'")] = ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._encoder, self._of_words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._of_words.normalizer = normalizers.Sequence([])
        self._of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self._encoder.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        # A piece with a special token's first character may hold one, so the library gets it whole.
        self._kind = _KIND.copy()
        for token in self._encoder.get_added_tokens_decoder().values():
            self._kind[token.content.encode()[0]] = ODD
        self._known = Memo(MOST_WORDS)

    def _whole(self, pieces: list[bytes]) -> list[bytes]:
        texts = [p.decode("utf-8", "surrogatepass") for p in pieces]
        return [np.array(c.ids, "<u4").tobytes() for c in self._encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Encode many words as one text; a word's last id is the only one that ends a word."""
        ids = np.array(self._of_words.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            return self._whole(words)
        data, at = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def _cut(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, lower-cased in pieces that are cut here; where each slice begins, with the end behind; and whether it is an odd piece."""
        begins = np.zeros(len(data) + 1, bool)
        np.logical_or(data == SPACE, data == FEED, out=begins[1:])
        begins[first] = True
        starts = np.flatnonzero(begins)
        if len(starts) < 2:
            return data, starts, np.zeros(0, bool)
        kind, turns, simple, odd = runs(data, begins, self._kind, ODD)
        turns |= kind[1:] == DIGIT
        turns &= kind[1:] != BLANK
        begins[1:-1] |= turns & simple[1:]
        lowered = np.where(simple, _LOWER[data], data)
        second = np.flatnonzero(data[:-1] == LATIN) + 1
        capitals = second[(data[second] <= CAPITALS) & simple[second]]
        lowered[capitals] += 32
        slices = np.flatnonzero(begins)
        return lowered, slices, np.repeat(odd, np.diff(np.searchsorted(slices, starts)))

    def encode_array(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end as unsigned 32-bit integers, each text's followed by end_id, and where each text's begin, with the end behind."""
        out, ends, total = [], [np.zeros(1, np.int64)], 0
        for data, first in chunks(texts):
            data, starts, odd = self._cut(data, first)
            numbers, found = distinct(data, starts)
            found = [s.rstrip(b" \n") for s in found]
            self._known.make_room()
            known = self._known
            made = list(map(known.get, found))
            whole = np.zeros(len(found), bool)
            whole[numbers[odd]] = True
            own: dict[bytes, bytes] = {b"": b""}
            for encode, of in ((self._words, ~whole), (self._whole, whole)):
                new = list({found[i] for i in np.flatnonzero(of).tolist() if made[i] is None and found[i]})
                if new:
                    own.update(zip(new, encode(new), strict=True))
            made = [own[s] if ids is None else ids for s, ids in zip(found, made, strict=True)]
            known.update((s, ids) for s, ids in own.items() if len(s) <= LONGEST_KEPT)
            # A text's first slice; those of empty texts are the next text's.
            place = np.searchsorted(starts, first)
            if end_id is not None:
                numbers = np.insert(numbers, place[1:], len(made))
                made.append(int(end_id).to_bytes(4, "little"))
                place = place + np.arange(len(place))
            flat, at = put(numbers, made)
            ids = flat.view("<u4")
            out.append(ids)
            ends.append(at[place[1:]] // 4 + total)
            total += len(ids)
        return (np.concatenate(out) if out else np.empty(0, "<u4")), np.concatenate(ends)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def tokenizer(path: str) -> WordTokenizer:
    return held(path, lambda: WordTokenizer(path))
