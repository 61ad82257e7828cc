"""Token ids of whole texts by a `tokenizers` vocabulary, word by word with a bounded memo.

The vocabulary's pre-tokenizer never joins what white space parts, so the ids of a text are the
ids of its white-space words in order. Words recur, so each worker process keeps their ids as
ready bytes. Words outside plain Latin letters, or with a special token's brackets, go
through the library whole; the others go straight to its BPE model.
"""

from __future__ import annotations

import os
import re
import struct
from codecs import charmap_decode
from functools import lru_cache

MEMO_WORDS = 400_000
MEMO_RUNS = 100_000

#: Python's split() also parts words at these control characters; the vocabulary doesn't.
ODD_SPLITS = "\x1c\x1d\x1e\x1f"

#: The pre-tokenizer pattern of word_bpe_49k.json.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: A run of letters that lower-case and compose one by one, and marks behind it.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,;:!?)]*)").fullmatch


def _byte_letters() -> str:
    """The printable stand-in of each byte in byte-level vocabularies, by byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


class _Memo(dict):
    """word -> little-endian unsigned 32-bit ids; a missing word is encoded and kept.

    Words that came up since the last turn are in the dict itself, those of the turn before in ``_old``, so that
    frequent words outlive the many that stand once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenize = self._tokenizer.model.tokenize
        self._find = regex.compile(WORD_PATTERN).findall
        self._letters = _byte_letters()
        self._packs = [struct.Struct(f"<{n}I").pack for n in range(64)]
        self._old: dict[str, bytes] = {}
        self._runs: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return self._packs[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: str) -> bytes:
        """Ids of a run of letters or of marks, lower case."""
        known = self._runs.get(run)
        if known is not None:
            return known
        spelled = run if run.isascii() and run.isprintable() else charmap_decode(run.encode(), "strict", self._letters)[0]
        out = self._pack([t.id for t in self._tokenize(spelled)])
        if len(self._runs) >= MEMO_RUNS:
            self._runs.clear()
        if len(run) < 64:
            self._runs[run] = out
        return out

    def _encode(self, word: str) -> bytes:
        plain = PLAIN(word)
        if plain is not None:
            letters, marks = plain.groups()
            return self._run(letters.lower()) + self._run(marks) if marks else self._run(letters.lower())
        if max(word) < "ɐ" and "<|" not in word:
            return b"".join(map(self._run, self._find(word.lower())))
        return self._pack(self._tokenizer.encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        out = self._old.get(word)
        if out is None:
            out = self._encode(word)
        if len(self) >= MEMO_WORDS // 2:
            self._old = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = out
        return out


class WordIds:
    def __init__(self, path: str):
        self._memo = _Memo(path)

    def encode(self, text: str) -> bytes:
        """All ids of the text, four little-endian bytes each."""
        if any(c in text for c in ODD_SPLITS):
            import regex

            words = [w for w in regex.split(r"\p{White_Space}+", text) if w]
        else:
            words = text.split()
        return b"".join(map(self._memo.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One encoder for each worker process."""
    return WordIds(path)
