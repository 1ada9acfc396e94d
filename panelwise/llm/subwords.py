"""Subword ids of whole texts, with a bounded cache of words."""

from __future__ import annotations

import base64
import os
import re
from array import array
from itertools import islice

import numpy as np

# Words whose ids a worker keeps; beyond it, those met last go.
CACHE = 600_000
LONGEST = 64
# Words that are coded in one text.
RUN = 512
# Letters below this are in the same classes for both libraries.
_LATIN = "\u0250"
_ANY_SPACE = re.compile(r"\s")
_SPACE_RUN = re.compile(r" \s")
_LOADED: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _quick(path: str):
    """The same vocabulary as ranks, if it lies beside; else None and the words are coded one by one."""
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of a byte-level BPE that splits before " x": a space and what follows it are coded apart from what precedes.

    So texts without white space behind a space are coded word by word, each distinct word once; others in one piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.quick = _quick(path)
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _code(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of single words, each with a space before it.

        Latin words without white space are coded a line each in long texts, the line feed being an id of its own between
        them, by the other library's form of the vocabulary, which is several times faster and gives the same ids.
        """
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w and max(w) < _LATIN and not _ANY_SPACE.search(w)]
        for at in range(0, len(plain) if self.quick else 0, RUN):
            part = plain[at:at + RUN]
            raw = array("I", self.quick.encode_ordinary("\n".join([" " + words[i] for i in part]))).tobytes()
            ids = np.frombuffer(raw, "<u4")
            ends = np.append(np.flatnonzero(ids == self.line_feed), len(ids)).tolist()
            if len(ends) == len(part):
                start = 0
                for i, end in zip(part, ends):
                    out[i] = raw[4 * start:4 * end]
                    start = end + 1
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._code([" " + words[i] for i in rest])):
            out[i] = x
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null has none."""
        split = [None if t and _SPACE_RUN.search(t) else (t or "").split(" ") for t in texts]
        known = self.words
        met = set().union(*[parts[1:] for parts in split if parts is not None])
        new = [w for w in met if w not in known]
        known.update(zip(new, self.ids_of_words(new)))
        # First words have no space before them, and texts of other shape are coded in one piece.
        whole = list(dict.fromkeys(t if parts is None else parts[0] for t, parts in zip(texts, split)))
        pieces = dict(zip(whole, self._code(whole)))
        out = [pieces[t] if parts is None else pieces[parts[0]] + b"".join(map(known.__getitem__, parts[1:]))
               for t, parts in zip(texts, split)]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        if len(known) > CACHE:
            self.words = dict(islice(known.items(), CACHE // 2))
        return out

    def keep(self, coded: dict[str, bytes]) -> None:
        self.spaced.update((k, v) for k, v in coded.items() if len(k) <= LONGEST)

    def trim(self) -> None:
        if len(self.spaced) > CACHE:
            self.spaced = dict(islice(self.spaced.items(), CACHE // 2))


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
