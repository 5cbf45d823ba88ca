"""Token ids of whole texts by the installed tokenizer library, with memory of pieces.

The library spends its time on the merges of rare words. It cuts a text into
pieces before it merges, so texts are cut by the same pattern, ids are looked up
per piece and the library's own BPE model is asked once per new piece: a word
costs one question, whatever its case (where that does not count) and whatever
stands beside it. Texts or settings for which the cutting is not known go through
the library as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

#: Pieces in the younger of two generations that a worker process remembers, and characters of the longest.
MOST_PIECES, LONGEST_PIECE = 250_000, 64

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters whose class, case and form the splitting below knows.
_KNOWN = re.compile(f"[ \\t\\n\\r!-~{_LATIN}]*")
#: The splitting patterns of the two vocabularies, over known characters.
_WORD_PIECES = re.compile("[%s]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\\s%s0-9]+" % (_LATIN.replace("A-Z", ""), _LATIN))
_BYTE_PIECES = re.compile(" ?[%s]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\\s%s0-9]+|\\s+(?!\\S)|\\s+" % (_LATIN, _LATIN))


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTERS = _byte_letters()


def settings(path: str) -> dict:
    """The parts of a tokenizer file that decide how text is split."""
    whole = json.loads(Path(path).read_text(encoding="utf-8"))
    return {k: v for k, v in whole.items() if k != "model"}


def digest(path: str) -> str:
    """Version of a tokenizer: digest of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _kind(s: dict) -> str | None:
    """Which known splitting a ``tokenizers`` file has, if any."""
    plain = s.get("truncation") is None and s.get("padding") is None and all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].startswith("<|") for t in s.get("added_tokens", [])
    )
    before, norm = s.get("pre_tokenizer") or {}, s.get("normalizer")
    if not plain:
        return None
    if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "byte"
    if norm is not None and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        steps = before.get("pretokenizers", [])
        if [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and not steps[1]["use_regex"]:
            if steps[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
                return "word"
    return None


class _Memory(dict):
    """Ids by piece: what ``learn`` gave, in two generations of bounded size; long pieces are not kept."""

    def __init__(self, learn):
        self.learn = learn
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST_PIECE:
            return self.learn(piece)
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece)
        if len(self) >= MOST_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """``encode`` gives the ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.kind = "sentencepiece"
            return
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = _kind(settings(path))
        self.model = self.tokenizer.model
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.memory = _Memory(self._piece)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", _LETTERS[32])
        else:
            letters = piece.encode().decode("latin-1").translate(_LETTERS)
        table = self.bytes
        return b"".join([table[t.id] for t in self.model.tokenize(letters)])

    def whole(self, text: str) -> bytes:
        """Ids by the library's own call on the whole text."""
        if self.kind == "sentencepiece":
            return np.array(self.pieces.encode(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind not in ("word", "byte") or "<|" in text or not _KNOWN.fullmatch(text):
            return self.whole(text)
        cut = _WORD_PIECES.findall(text.lower()) if self.kind == "word" else _BYTE_PIECES.findall(text)
        return b"".join(map(self.memory.__getitem__, cut))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


