"""Exact token ids of whole texts with a public word-level BPE, at the speed of a word cache.

The tokenizer splits at white space before its merges, so the ids of a text are those of its words in
turn; full stops and commas after letters count as words of their own. Each worker process keeps a
bounded cache from words to packed ids; texts for which words could be encoded differently from the
whole (special tokens, a few control characters, final sigma, text that isn't in composed form) go
through the tokenizer whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Sequence
from functools import cache
from itertools import islice

import numpy as np

CACHE_WORDS = 350_000
#: What stays when the cache is full: the words met first, among which the frequent ones are.
KEEP_WORDS = 250_000
#: Characters and strings that make a text's encoding more than that of its lower-cased words.
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "Σ", "İ")
#: Marks that end words; after letters they are one piece, which an apostrophe may not be.
_TAIL = ".,;:!?*#$&%\"()[]-"
#: Texts whose words are looked up together.
GROUP = 8


def _apart(text: str) -> str:
    """A space before full stops and commas that follow a letter, a number or white space, so that the word is the same with and without.

    There a piece ends anyway; inside a run of other marks it wouldn't, so such texts stay as they are.
    """
    for mark in ".,":
        if mark in text:
            before = text.split(mark)[:-1]
            if all(p[-1:].isalnum() or p[-1:].isspace() for p in before):
                text = text.replace(mark, " " + mark)
    return text


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """``encode(texts)`` gives, for each, its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _direct(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(list(texts), add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        known = self.words
        split, new = {}, set()
        for w in words:
            if w.isalpha():  # letters only: one piece
                new.add(w)
            else:
                head = w.rstrip(_TAIL)
                split[w] = ps = (head, w[len(head) :]) if head.isalpha() and head != w else self.parts(w)
                new.update(ps)
        new = list(new.difference(known))
        for at in range(0, len(new), 128):
            self._learn_pieces(new[at : at + 128])
        get = known.__getitem__
        for w, ps in split.items():
            known[w] = b"".join(map(get, ps))

    def _learn_pieces(self, new: list[str]) -> None:
        """One call for many pieces: each piece's last id, and no other, is that of a word end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new) or cuts[-1] != len(ids):
            self.words.update(zip(new, self._direct(new)))
            return
        raw, stops = ids.tobytes(), (cuts * 4).tolist()
        self.words.update((p, raw[i:j]) for p, i, j in zip(new, [0, *stops], stops))

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole, plain = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(x in t for x in _WHOLE) or not unicodedata.is_normalized("NFC", t):
                whole.append(i)
            else:
                plain.append(i)
        if whole:
            for i, ids in zip(whole, self._direct([texts[i] for i in whole])):
                out[i] = ids
        for start in range(0, len(plain), GROUP):
            group = [(i, _apart(texts[i].lower()).split()) for i in plain[start : start + GROUP]]
            if len(self.words) > CACHE_WORDS:
                self.words = dict(islice(self.words.items(), KEEP_WORDS))
            missing = set().union(*(ws for _, ws in group)).difference(self.words)
            if missing:
                self._learn(missing)
            get = self.words.__getitem__
            for i, ws in group:
                out[i] = b"".join(map(get, ws))
        return out


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(path)


def encode_lengths(texts: Sequence[str | None], path: str) -> list[int]:
    return [len(x) // 4 for x in encoder(path).encode(texts)]
