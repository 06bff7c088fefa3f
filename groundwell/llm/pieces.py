"""Byte-level BPE over whole Arrow batches, encoding every distinct piece of text once per worker.

The pre-tokenizer of these tokenizers starts a new word at a space that is followed by something
that is no white space, and where punctuation follows a letter, so a text can be cut there and its
pieces encoded one by one: the ids of the pieces in a row are the ids of the text. Cuts are only
made where the bytes leave no doubt. Added tokens are ids of their own wherever a text holds them: the
library takes them out first, so a text is cut before and behind them and never inside. Pieces repeat a lot; a worker keeps the ids of up to CACHED of them by hash and length.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from groundwell.llm import words as w

#: Pieces whose ids a worker keeps; beyond that it starts again with those of the block at hand.
CACHED = 1_500_000
#: New pieces that are encoded in one text, and texts in one call: the library's results are large.
TOGETHER, TEXTS = 512, 32
#: Bytes that begin no white space and no control character.
SOLID = np.ones(256, bool)
SOLID[:0x21] = False
SOLID[[0x7F, *range(0x80, 0xC3), 0xE1, 0xE2, 0xE3]] = False
#: ASCII letters, and ASCII punctuation but the apostrophe, which can belong to a contraction.
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces begin: at texts, at spaces before solid bytes of the same text, at marks behind letters."""
    begin = np.zeros(len(data) + 1, bool)
    begin[:-2][(data[:-1] == 0x20) & SOLID[data[1:]]] = True
    ends = at[1:][at[1:] > 0] - 1
    begin[ends] = False  # a space at the end of a text
    begin[1:-1] |= LETTER[data[:-1]] & MARK[data[1:]]
    begin[at[:-1]] = True
    return np.flatnonzero(begin[:-1])


class Encoder:
    """With `added` an added token in a text is its own id, as in the library; else it is text like any other."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized or re.search(r"\s", t.content) for t in tokens.values()):
            raise ValueError(f"{path}: added tokens with white space or rules of their own")
        # Of tokens that begin alike the longest is found.
        self.literals = sorted((t.content.encode() for t in tokens.values()), key=len, reverse=True)
        self.literal = re.compile(b"|".join(map(re.escape, self.literals)))
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id: the vocabulary has a character for every byte.
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.size[number] = len(token)
        for number, token in tokens.items():
            self.size[number] = len(token.content.encode())
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        # Pieces that begin at a safe cut are encoded many in one text, which cuts them again there.
        safe = np.fromiter((p[:1] == b" " and len(p) > 1 and SOLID[p[1]] for p in pieces), bool, len(pieces))
        order = np.concatenate([np.flatnonzero(~safe), np.flatnonzero(safe)])
        alone = int((~safe).sum())
        texts = [pieces[i].decode() for i in order[:alone].tolist()]
        rest = order[alone:].tolist()
        for k in range(0, len(rest), TOGETHER):
            texts.append(b"".join([pieces[i] for i in rest[k : k + TOGETHER]]).decode())
        flat = np.concatenate([self._ids_of(texts[k : k + TEXTS]) for k in range(0, len(texts), TEXTS)])
        # A piece ends with the id that has its last byte.
        ends = np.searchsorted(np.cumsum(self.size[flat]), np.cumsum([len(pieces[i]) for i in order.tolist()])) + 1
        upto = np.empty(len(pieces), np.int64)
        upto[order] = ends
        count = np.empty(len(pieces), np.int64)
        count[order] = np.diff(ends, prepend=0)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.begin = np.insert(self.begin, place, len(self.ids) + upto - count)
        self.count = np.insert(self.count, place, count)
        self.ids = np.concatenate([self.ids, flat])

    def _ids_of(self, texts: list[str]) -> np.ndarray:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))

    def _cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin, raw = cuts(data, at), data.tobytes()
        if not any(x in raw for x in self.literals):
            return begin
        keep = np.zeros(len(data) + 1, bool)
        keep[begin] = True
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            for found in self.literal.finditer(raw, a, b):
                low, high = found.span()
                keep[low + 1 : high] = False
                keep[[low, high]] = True
        return np.flatnonzero(keep[:-1])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one entry more than texts)."""
        begin = self._cuts(data, at)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        end = np.append(begin[1:], len(data))
        keys = w.hashes(data, begin, end)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > CACHED:
                self._empty()
                new[:] = True
            raw = data.tobytes()
            where = first[new]
            pieces = [raw[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)]
            self._learn(distinct[new], pieces)
            place = np.searchsorted(self.keys, distinct)
        count = self.count[place][which]
        upto = np.cumsum(count)
        total = int(upto[-1])
        shift = self.begin[place][which] - (upto - count)
        ids = self.ids[np.repeat(shift, count) + np.arange(total)]
        return ids, np.concatenate([[0], upto])[np.searchsorted(begin, at)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker."""
    return Encoder(path, added=True)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
