"""Token ids of whole texts, as the tokenizers library gives them, with bounded caches.

Where a tokenizer drops white space before it merges, a text's ids are those of its pieces
(runs of letters, single numbers, runs of other characters) in turn. Words and pieces repeat,
so each worker keeps two bounded maps, from white-space words and from pieces to ids, and codes
only pieces that it has not seen. Words with characters whose treatment could depend on the
Unicode version are normalised and cut into pieces by the library's own steps; neither these nor
merges reach over ASCII white space. Words with a special token are coded by the library.
"""

from __future__ import annotations

import array
import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

#: Words and pieces that a worker's two maps hold at most; a full map is emptied by half.
MAX_WORDS = 500_000
#: Longer words are coded each time and not kept.
MAX_WORD_CHARS = 64

#: Code points of the plain path: up to U+024F, without U+001C-1F, U+0085, U+00A0 (white space for some
#: libraries only) and U+0130 (two characters in lower case). None of them combines, so NFC leaves them alone.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ɏ]")
#: Fixed value: the split that the plain path knows, as it stands in tokenizer files.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(kind: str) -> str:
    lower = {ord(x) for c in range(0x250) for x in chr(c).lower()}  # some lie far beyond the letter itself
    return "".join(f"\\u{c:04x}" for c in sorted({*range(0x250), *lower}) if unicodedata.category(chr(c))[0] == kind)


#: The same split for the plain path's characters; words hold no white space.
ASCII_WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_class('L')}{_class('N')}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, without its truncation and padding; one per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def settings(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def knows(path: str) -> bool:
    """True if the plain path does what the tokenizer's own steps do."""
    s = settings(path)
    steps = [x.get("type") for x in (s.get("normalizer") or {}).get("normalizers", [])]
    pre = (s.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = s.get("model") or {}
    return bool(
        steps == ["NFC", "Replace", "Lowercase"]
        and [x.get("type") for x in pre] == ["Split", "ByteLevel"]
        and pre[0].get("pattern") == {"Regex": KNOWN_SPLIT}
        and (pre[0].get("behavior"), pre[0].get("invert")) == ("Removed", True)
        and (pre[1].get("add_prefix_space"), pre[1].get("use_regex")) == (False, False)
        and not s.get("post_processor")
        and model.get("type", "BPE") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    )


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


def as_letters(piece: str) -> str:
    """A piece with each of its UTF-8 bytes as a letter."""
    if piece.isascii() and piece.isprintable():
        return piece
    return piece.encode("utf-8").decode("latin-1").translate(byte_letters())


class LibraryCoder:
    """Ids of pieces, given as letters for their bytes, by the library's own model."""

    def __init__(self, path: str):
        self.model = load(path).model

    def ids(self, pieces: list[str]) -> list[list[int]]:
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(p)] for p in pieces]


def _keep(known: dict[str, bytes], new: dict[str, bytes], most: int) -> None:
    if len(known) + len(new) > most:
        for key in list(known)[: max(len(known) // 2, len(known) + len(new) - most)]:
            del known[key]
    if len(known) + len(new) > most:
        new = dict(list(new.items())[: max(most - len(known), 0)])
    known.update(new if max(map(len, new), default=0) <= MAX_WORD_CHARS else {k: v for k, v in new.items() if len(k) <= MAX_WORD_CHARS})


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, coder=None, max_words: int = MAX_WORDS):
        self.tokenizer = load(path)
        self.plain = knows(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(len(ASCII_WORDS.findall(s)) != 1 or ASCII_WORDS.findall(s) != [s] for s in self.special):
            self.plain = False  # a special token with white space reaches over words
        self.coder = coder or LibraryCoder(path)
        self.max_words = max_words
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pieces(self, word: str) -> list[str]:
        """A word's pieces, each byte as a letter."""
        if not UNUSUAL.search(word):
            return [as_letters(p) for p in PIECES.findall(word.lower())]
        plain = self.tokenizer.normalizer.normalize_str(word)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def _learn(self, missing: set[str], text: str, usual: bool) -> dict[str, bytes]:
        """Ids of words of a text, which has no unusual characters if it is ``usual``."""
        special = [s for s in self.special if s in text]
        out = {w: self.whole(w) for w in missing if any(s in w for s in special)} if special else {}
        have, lone, cut = self.pieces, [], {}
        for w in missing.difference(out) if out else missing:
            if w.isalpha() and (usual or w.isascii()):
                lone.append(w)  # a single piece
            else:
                cut[w] = list(map(as_letters, PIECES.findall(w.lower()))) if usual else self._pieces(w)
        lower = [p if p.isascii() else as_letters(p) for p in map(str.lower, lone)]
        unseen = list({p for p in chain(lower, chain.from_iterable(cut.values())) if p not in have})
        new = dict(zip(unseen, [array.array("I", i).tobytes() for i in self.coder.ids(unseen)], strict=True))
        out.update(zip(lone, [new[p] if p in new else have[p] for p in lower], strict=True))
        for w, ps in cut.items():
            out[w] = b"".join([new[p] if p in new else have[p] for p in ps])
        _keep(have, new, self.max_words)
        return out

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """One bytes value per text; a null text is empty."""
        out: list[bytes] = []
        known = self.words
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.plain:
                out.append(self.whole(text))
            else:
                usual = not UNUSUAL.search(text)
                split = text.split() if usual else ASCII_WORDS.findall(text)
                got = list(map(known.get, split))
                if None in got:
                    new = self._learn({w for w, v in zip(split, got, strict=True) if v is None}, text, usual)
                    got = [new[w] if v is None else v for w, v in zip(split, got, strict=True)]
                    _keep(known, new, self.max_words)
                out.append(b"".join(got))
        return out
