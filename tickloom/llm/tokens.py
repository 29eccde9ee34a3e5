"""Token ids of whole texts by a public tokenizer whose words end at white space."""

from __future__ import annotations

import os

import numpy as np

#: Words, and parts of words, kept with their ids by each task; the rest are encoded anew.
MEMO_WORDS, MEMO_PARTS = 300_000, 300_000
#: Signs whose run at a word's end is one piece of the pre-tokenizer: all of ASCII but the apostrophe.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_memo: dict[str, WordTokenizer] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts, word by word; the library's ids of a word are kept in a bounded memo.

    The vocabulary's pre-tokenizer never joins letters across white space, so the ids of
    a text are those of its words one after another; a run of signs after Latin letters is
    a piece of its own, and letters are lower-cased. Ids fit 16 bits.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(256)) if c.isalpha()]
        self.levels = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.memo: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian 16-bit integers."""
        words = text.split()
        found = list(map(self.memo.get, words))
        if None in found:
            fresh = self._fresh({w for w, x in zip(words, found, strict=True) if x is None})
            found = [fresh[w] if x is None else x for w, x in zip(words, found, strict=True)]
            if len(self.memo) < MEMO_WORDS:
                self.memo.update((w, x) for w, x in fresh.items() if len(w) <= 64)
        return b"".join(found)

    def _fresh(self, words: set[bytes]) -> dict[bytes, bytes]:
        split = {w: _letters_and_signs(w) for w in words}
        known = self.parts
        letters = {pair[0] for pair in split.values() if len(pair) == 2 and pair[0] not in known}
        others = list({pair[-1] for pair in split.values() if pair[-1] and pair[-1] not in known})
        encoded = self.tokenizer.encode_batch_fast([x.decode() for x in others], add_special_tokens=False)
        new = {w: np.array(x.ids, "<u2").tobytes() for w, x in zip(others, encoded, strict=True)}
        piece = self.tokenizer.model.tokenize
        for x in letters:
            new[x] = np.array([t.id for t in piece(x.decode().translate(self.levels))], "<u2").tobytes()
        new[b""] = b""
        out = {w: b"".join([new[x] if x in new else known[x] for x in pair]) for w, pair in split.items()}
        if len(known) < MEMO_PARTS:
            known.update((w, x) for w, x in new.items() if len(w) <= 64)
        return out


def _letters_and_signs(word: bytes) -> tuple[bytes, ...]:
    """A word of Latin letters and final signs in these two parts, lower-cased; any other word whole.

    Such letters are one piece of the pre-tokenizer, so the model takes them as they are.
    """
    letters = word.rstrip(SIGNS)
    if letters.isascii():
        return (letters.lower(), word[len(letters) :]) if letters.isalpha() else (word,)
    text = letters.decode()
    return (text.lower().encode(), word[len(letters) :]) if text.isalpha() and max(text) < "\u0100" else (word,)


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker and path."""
    if path not in _memo:
        _memo[path] = WordTokenizer(path)
    return _memo[path]


def as_u32(ids: bytes) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes()
