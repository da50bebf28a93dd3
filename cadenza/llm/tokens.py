"""Token ids of whole texts by a public word-end BPE vocabulary.

Its pre-tokens never cross white space, so ids of white-space-separated chunks
are remembered for the life of a Python worker and a text is the join of its
chunks. Texts where that would not hold go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from unicodedata import is_normalized

import numpy as np

#: Chunks, and parts of chunks, that a Python worker remembers.
REMEMBERED = 500_000
#: Where Python splits and the tokenizer does not, and special tokens, which may hold or touch any text.
_WHOLE = re.compile("[\x1c-\x1f]|<\\|(?:start|end)oftext\\|>")
#: None of these starts or joins a pre-token with letters before it.
_MARKS = ".,;:!?*$%&#)]\""
#: Runs of letters that are encoded as one text.
JOINED = 100
_known: dict[str, ChunkTokenizer] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for own in ids:
                own.byteswap()
        return [own.tobytes() for own in ids]

    def _encode_letters(self, texts: list[str]) -> list[bytes]:
        """Runs of letters are one pre-token each, whose last id alone ends a word; so JOINED of them are encoded as one text and cut there."""
        lines = [" ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(texts) or ends[-1] != len(ids):
            return self._encode(texts)
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _remember(self, known: dict[str, bytes], new: list[str], letters: bool = False) -> None:
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            known.update(zip(part, (self._encode_letters if letters else self._encode)(part), strict=True))

    def _learn(self, new: list[str]) -> None:
        """A chunk that is letters and then punctuation is two pre-tokens, and letters are remembered in lower case."""
        own, heads, tails, others = [], [], [], []
        for c in new:
            letters = c.rstrip(_MARKS)
            if letters.isalpha() and (c.isascii() or is_normalized("NFC", c) and "\u03a3" not in letters):
                own.append(c)
                heads.append(letters.lower())
                tails.append(c[len(letters) :])
            else:
                others.append(c)
        self._remember(self.chunks, others)
        pieces, used = self.pieces, set(heads).union(tails)
        missing = [x for x in used if x not in pieces]
        if len(pieces) + len(missing) > REMEMBERED:
            pieces.clear()
            missing = list(used)
        self._remember(pieces, [x for x in missing if x.isalpha()], True)
        self._remember(pieces, [x for x in missing if not x.isalpha()])
        self.chunks.update((c, pieces[a] + pieces[b] if b else pieces[a]) for c, a, b in zip(own, heads, tails, strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text."""
        split, known = [None if _WHOLE.search(t) else t.split() for t in texts], self.chunks
        wanted = set().union(*filter(None, split))
        new = [c for c in wanted if c not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(wanted)
        self._learn(new)
        return [self._encode([t])[0] if chunks is None else b"".join(map(known.__getitem__, chunks)) for t, chunks in zip(texts, split, strict=True)]


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _known:
        _known[path] = ChunkTokenizer(path)
    return _known[path]


def forget() -> None:
    """Let go of what this Python worker remembers of earlier stages; workers are used again, and later stages need the memory."""
    _known.clear()
