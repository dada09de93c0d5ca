"""Token ids from the tokenizers library, asked once for each distinct piece of text between two spaces.

A tokenizer whose normaliser turns runs of white space into one space and whose pre-tokeniser then drops it cannot carry
anything across a space: its added tokens hold no space, no canonical composition starts at one, and no match of its split
pattern contains one. The ids of a text are then the ids of its pieces, one after the other, whatever the pieces' context,
so the library is asked for new pieces only. Texts of any other tokenizer go to the library whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that one worker remembers, and words and marks in them; what is full starts anew. A bound on memory, without effect on results.
MEMO = 1_000_000
#: Letters up to this one are composed already and have the same lower case everywhere.
LAST_PLAIN = "\u00ff"
#: The split pattern and byte alphabet under which a word of letters is one match, spelt byte by byte.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}

#: Marks that, after letters and up to the next space, are one match of that pattern (an apostrophe may start another one).
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

_loaded: dict[str, "PieceEncoder"] = {}


def drops_space(path: str) -> bool:
    """Whether the tokenizer file declares the property that the module's docstring needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = lambda x, key: [] if x is None else x.get(key, [x])
    squeezed = any(n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in parts(spec["normalizer"], "normalizers"))
    first = (parts(spec["pre_tokenizer"], "pretokenizers") or [{"type": ""}])[0]
    removed = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and "[^\\s" in first["pattern"].get("Regex", "")
    plain = all(not t["single_word"] and not t["lstrip"] and not t["rstrip"] and " " not in t["content"] for t in spec["added_tokens"])
    return squeezed and removed and plain and spec["model"].get("dropout") is None


def splits_words(path: str) -> bool:
    """Whether a run of letters after a space, and a run of marks after it, are each one match that the model gets in bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    return normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_PATTERN} and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]


class _Memo(dict):
    """Ids of pieces, as little-endian 32-bit integers; a new piece is looked up in the library once."""

    def __init__(self, encoder: PieceEncoder):
        self.encode = encoder.piece

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


class PieceEncoder:
    """ids(texts) and count(texts) of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_piece = drops_space(path)
        self.by_word = self.by_piece and splits_words(path)
        self.model = self.library.model
        self.words: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {"": b""}
        self.memo = _Memo(self)

    def piece(self, piece: str) -> bytes:
        low = piece.lower()
        word = low.rstrip(_MARKS)
        if self.by_word and (not word or word.isalpha() and (piece.isascii() or max(word) <= LAST_PLAIN and max(piece) <= LAST_PLAIN)):
            ids = self.words.get(word)
            if ids is None:
                # all of it is one match of the split pattern, so it may go straight to the library's model
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = self.words[word] = _packed([t.id for t in self.model.tokenize(spelt)])
            if len(word) == len(low):
                return ids
            mark = low[len(word) :]
            tail = self.marks.get(mark)
            if tail is None:
                tail = self.marks[mark] = _packed(self.library.encode(mark, add_special_tokens=False).ids)
            return ids + tail
        return _packed(self.library.encode(piece, add_special_tokens=False).ids)

    def _parts(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_piece:
            return [_packed(e.ids) for e in self.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if len(self.memo) > MEMO:
            self.memo = _Memo(self)
        if len(self.words) > MEMO:
            self.words = {"": b""}
        if len(self.marks) > MEMO:
            self.marks = {"": b""}
        look = self.memo.__getitem__
        return [b"".join(map(look, (t or "").replace("\n", " ").split(" "))) for t in texts]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of each text. Null counts as empty."""
        parts = self._parts(texts)
        return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text. Null counts as empty."""
        return [len(p) // 4 for p in self._parts(texts)]


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a file, loaded once."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]
