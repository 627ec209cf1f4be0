"""Token ids by the tokenizers library, with a bounded cache of words.

The tokenizer's pattern never joins characters across a space or a line feed, so
a text's ids are those of its pieces between them, in order. That lets a worker
keep the ids of pieces it has met. A piece that ends in ASCII punctuation after
an ASCII letter or digit, and the case of an ASCII piece, don't change the
other part's ids either (the pattern ends a run there, the normaliser lowers
case); tests hold the outcome against the library's on whole texts.
"""

from __future__ import annotations

import array
import json
import sys

from . import caches

#: Without the apostrophe, which the pattern joins to letters.
_PUNCTUATION = '!"#$%&()*+,-./:;=?@[\\]^_`{}~|'


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for
    themselves, the others follow after 255 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Pieces(dict):
    def __init__(self, tokenizer, most: int):
        super().__init__()
        self.tokenizer, self.most = tokenizer, most
        self.model, self.letters = tokenizer.model, _byte_letters()
        self.special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, piece: str) -> bytes:
        if piece.isalpha() and max(piece) <= "\xff":
            # one run of letters, no composition: the model alone does what the library would
            word = piece.lower()
            if not word.isascii():
                word = "".join(self.letters[b] for b in word.encode())
            ids = [x.id for x in self.model.tokenize(word)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return _packed(ids)

    def __missing__(self, piece: str) -> bytes:
        ids = None
        if len(piece) <= 48 and not any(x in piece for x in self.special):
            core = piece.rstrip(_PUNCTUATION)
            if core and len(core) < len(piece) and core[-1].isascii() and core[-1].isalnum():
                ids = self[core] + self[piece[len(core):]]
            elif piece.isascii() and (low := piece.lower()) != piece:
                ids = self[low]
        if ids is None:
            ids = self._encode(piece)
        if len(piece) <= 48 and len(self) < self.most:
            self[piece] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    held = array.array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split = _splits_at_spaces(spec)
        self.pieces = _Pieces(self.tokenizer, most)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def encode(self, text: str) -> bytes:
        if not self.split:
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


#: The normaliser and the pre-tokenizer of the tokenizer files that the cache holds for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _splits_at_spaces(spec: dict) -> bool:
    """Whether the file's tokenizer is the one that the cache holds for: any other
    normaliser, pre-tokenizer, kind of model or added token goes by the library alone."""
    model = spec.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "unk_token"))
    added = all(not x.get(k) for x in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return plain and added and not spec.get("truncation") and spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == _PRE_TOKENIZER


_encoders: dict[tuple[str, str], Encoder] = {}
caches.register("tokens", _encoders.clear)


def encoder(path: str, call: str = "") -> Encoder:
    """One for each worker process, file and call of an operator.

    A new call starts with an empty cache: a reused worker would else hold the words of
    all corpora that it has met."""
    caches.only("tokens")
    if (path, call) not in _encoders:
        _encoders.clear()
        _encoders[path, call] = Encoder(path)
    return _encoders[path, call]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
