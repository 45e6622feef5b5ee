"""Token ids of whole texts with a public tokenizer file, a word at a time with a cache."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Distinct words whose ids a worker keeps; it starts anew beyond that, so a batch of texts may add to them.
CACHE = 400_000
#: Words longer than this many characters aren't kept.
LONGEST = 64
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
#: Words, and apart from them the punctuation after words of plain letters.
_WORDS = re.compile(_LETTERS + r"(?=[.,!?;:$%&*#|]*(?:[ \n]|\Z))|[^ \n]+")
_PLAIN = re.compile(_LETTERS)


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class WordEncoder:
    """Encodes a text as its words (runs without space or line feed), each on its own.

    This is exact for tokenizers whose tokens never span white space, nor a change from letters to punctuation other
    than the apostrophe, and that drop white space, as word-end BPE vocabularies do. The ids of known words lie one
    after another in one array; a text is a gather from it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.size = self._tokenizer.get_vocab_size()
        self._ends = np.zeros(max(self._tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self._known = _Numbered()
        self._flat = np.zeros(0, np.uint32)
        self._begin, self._count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Append the ids of new words, many encoded as one text. A plain word is over at an end-of-word token; for
        other words, offsets tell which ids are whose."""
        plain = [i for i, w in enumerate(words) if _PLAIN.fullmatch(w)]
        kept = set(plain)
        other = [i for i in range(len(words)) if i not in kept]
        flat, count, begin, at = [self._flat], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), len(self._flat)
        for i in range(0, len(plain), 2_000):
            part = plain[i : i + 2_000]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join([words[k] for k in part])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self._ends[ids])
            if len(ends) != len(part):
                other += plain[i:]
                break
            count[part] = np.diff(ends, prepend=-1)
            begin[part] = at + ends + 1 - count[part]
            flat.append(ids)
            at += len(ids)
        for i in range(0, len(other), 2_000):
            part = other[i : i + 2_000]
            own = [words[k] for k in part]
            e = self._tokenizer.encode(" ".join(own), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            begins = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            count[part] = np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(part))
            begin[part] = at + np.cumsum(count[part]) - count[part]
            flat.append(np.array(e.ids, np.uint32))
            at += len(e.ids)
        self._begin, self._count = np.concatenate((self._begin, begin)), np.concatenate((self._count, count))
        self._flat = np.concatenate(flat)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        if len(self._known) > CACHE:
            self._forget()
        # Letters of Latin-1 have one lower case each, and composing them changes nothing; special tokens keep theirs.
        words = [_WORDS.findall(t.lower() if "<|" not in t and (t.isascii() or _latin(t)) else t) for t in texts]
        find, empty = self._known.__getitem__, np.zeros(0, np.uint32)
        at = [np.fromiter(map(find, ws), np.int64, len(ws)) for ws in words]
        fresh, self._known.fresh = self._known.fresh, []
        if fresh:
            self._learn(fresh)
        out = [self._gathered(a) if len(a) else empty for a in at]
        if any(len(w) > LONGEST for w in fresh):
            self._forget()
        return out

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        begin, n = self._begin[at], self._count[at]
        ran = np.cumsum(n)
        return self._flat[np.arange(ran[-1]) + np.repeat(begin - ran + n, n)]


class _Numbered(dict):
    """Numbers words in the order in which they are first looked up, and lists the new ones."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
