"""Token ids of whole texts by a public tokenizer file, inside Spark's Python workers.

Most words of a corpus repeat, so a worker remembers the ids of the units it has met, within a
bound of bytes. The result is that of the tokenizer on the whole text: this holds for word-end BPE
files, which lower-case, drop white space and never join ids across their units (tests compare).
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

MEMORY = 64 << 20  # bytes of words and ids that a worker remembers before it starts afresh
_WORD_COST = 250  # bytes of a remembered word besides its own bytes and ids
_MARK = "<|"  # how special tokens begin
# Texts of these characters are cut by the pattern below exactly as the file cuts them (a test compares)
_EASY = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_UNIT = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\xc3\x80-\xbf]+|[0-9]|[^\sa-z0-9\xc3\x80-\xbf]+")


@lru_cache(maxsize=4)
def _encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _pieces(path: str):
    """The file's byte pair merges in a faster library, for runs of letters; None where the file has no word ends.

    The byte 255, which UTF-8 never holds, stands for the end of a word. The file numbers the bytes,
    then the bytes that end a word, then its merges in their order, so numbers are ranks.
    """
    import json

    import tiktoken

    model = json.loads(_encoder(path).to_str())["model"]
    end = model.get("end_of_word_suffix")
    if not end:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {}
    for token, number in model["vocab"].items():
        ends = token.endswith(end)
        core = token.removesuffix(end) if ends else token
        if set(core) <= letters.keys():
            ranks[bytes(letters[c] for c in core) + (b"\xff" if ends else b"")] = number
    if len({*ranks.values()}) != len(ranks) or any(number >= 512 and len(t) < 2 for t, number in ranks.items()):
        return None
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes; units that repeat are encoded once."""

    def __init__(self, path: str) -> None:
        self.path, self.known, self.size = path, {}, 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        Special tokens are found in the text as it is written, so texts that may hold one go to the
        tokenizer whole, as do texts with characters beyond the plain ones.
        """
        piece = _pieces(self.path)
        easy = [piece is not None and _MARK not in t and _EASY.fullmatch(t) is not None for t in texts]
        units = [_UNIT.findall(t.lower().encode()) if e else None for t, e in zip(texts, easy, strict=True)]
        if self.size > MEMORY:
            self.known.clear()
            self.size = 0
        known = self.known
        for unit in set().union(*[u for u in units if u]).difference(known):
            ids = known[unit] = array("I", piece(unit + b"\xff")).tobytes()
            self.size += len(unit) + len(ids) + _WORD_COST
        rest = [t for t, e in zip(texts, easy, strict=True) if not e]
        whole = iter(_encoder(self.path).encode_batch_fast(rest, add_special_tokens=False) if rest else [])
        return [array("I", next(whole).ids).tobytes() if u is None else b"".join(map(known.__getitem__, u)) for u in units]


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """The memory of this worker for one tokenizer file."""
    return WordIds(path)
