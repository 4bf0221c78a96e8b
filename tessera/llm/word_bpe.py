"""Token ids of the public lower-casing word BPE vocabulary, equal to those of ``tokenizers``.

``tokenizers`` spends some 20 microseconds on a word. The same merges run several times faster when
the vocabulary is handed to ``tiktoken`` as ranks: a blank stands for the vocabulary's end-of-word
mark, and as the ids of byte + mark pairs come before those of all merges, the mark is joined to the
last byte first, as it should be. Texts are lowered and cut as Latin-1 bytes by tables, and words kept in a bounded cache. Texts with characters beyond
ASCII and the Latin-1 letters, and texts that may hold special tokens, go to ``tokenizers`` itself.
The path of the vocabulary is a parameter; nothing of it is kept in the repository.
"""

from __future__ import annotations

import array
import json
import re

MAX_WORDS = 300_000  # cached words in one Python worker
MARK = "</w>"

_PIECE = re.compile(rb"'(?:[stmd]|re|ve|ll)|[0-9]|[!-/:-@\[-`{-~]+")
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])  # ASCII and Latin-1 letters
_LOWER = bytes(32 if c in b"\n\r\t" else ord(chr(c).lower()) for c in range(256))
_MARKS = bytes(b"."[0] if chr(c).isascii() and chr(c).isprintable() and not chr(c).isalnum() and c != 32 else 32 for c in range(256))


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordBpe(dict):
    """``ids(text)``: the little-endian unsigned 32-bit ids of a text as bytes. The dict is the cache."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["id"] for t in model["added_tokens"]}
        byte = _byte_of_char()
        ranks = {}
        for token, i in model["model"]["vocab"].items():
            if i in special:
                continue
            ends = token.endswith(MARK) and token != MARK
            core = token[: -len(MARK)] if ends else token
            ranks[bytes(byte[c] for c in core) + b" " * ends] = i
        self.fast = tiktoken.Encoding("word_bpe", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self[b""] = b""

    def __missing__(self, word: bytes) -> bytes:
        ids = array.array("I", self.fast.encode_ordinary((_PIECE.sub(rb" \g<0> ", word) + b" ").decode("latin-1"))).tobytes()
        if len(self) >= MAX_WORDS:
            self.clear()
            self[b""] = b""
        if len(word) < 64:
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = b"<|"
        if b"<|" in raw or raw.translate(None, _PLAIN):
            return array.array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        raw = raw.translate(_LOWER)
        if b"'" in raw or b".." in raw.translate(_MARKS):
            raw = _PIECE.sub(rb" \g<0> ", raw)
        else:  # no two marks touch: full stops and commas can be cut off without looking around
            raw = raw.replace(b".", b" . ").replace(b",", b" , ")
        return b"".join(map(self.__getitem__, raw.split(b" ")))


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The encoder of a vocabulary file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
