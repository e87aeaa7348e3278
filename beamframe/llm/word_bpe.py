"""Exact word-level encoding for the word-end BPE vocabulary, with a bounded cache.

The vocabulary's pre-tokenizer never joins text across white space and its normalizer works
character by character, so the ids of a text are the ids of its white-space separated pieces in
order. A piece is encoded once and remembered; pieces of plain Latin letters go straight to the
merge model, anything else through the library's full pipeline."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

from beamframe.llm.common import held

VOCAB_FILE = "word_bpe_49k.json"
END = "</w>"
#: str.split() also breaks at these four separators, which the pre-tokenizer keeps as symbols
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_LETTERS_MARK = re.compile(r"([A-Za-zÀ-ɏ]+)([!-/:-@\[-`{-~]+)")


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCAB_FILE)


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest from 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_core(path: str):
    """The same merges as a byte-pair core keyed by token bytes, with 0xff as the end-of-word mark.

    Merging by the rank of the joined bytes equals merging by the pair list when every token is
    what the pair list makes of its own string (`unreachable_tokens` is empty)."""
    import tiktoken

    back = {c: b for b, c in _byte_chars().items()}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks = {}
    for token, i in vocab.items():
        body, end = (token[: -len(END)], b"\xff") if token.endswith(END) and len(token) > len(END) else (token, b"")
        ranks[bytes(back[c] for c in body) + end] = i
    return tiktoken.Encoding("words", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe


def unreachable_tokens(path: str) -> list[str]:
    """Tokens that the pair list does not make of their own string (none in the default file)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    bad = []
    for token in model["vocab"]:
        sym = list(token[: -len(END)] if token.endswith(END) and len(token) > len(END) else token)
        if len(token) > len(END) and token.endswith(END):
            sym[-1] += END
        while len(sym) > 1:
            i = min(range(len(sym) - 1), key=lambda k: rank.get((sym[k], sym[k + 1]), len(rank)))
            if (sym[i], sym[i + 1]) not in rank:
                break
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
        if sym != [token]:
            bad.append(token)
    return bad


def plain_letters(word: str) -> bool:
    """Latin letters that stay letters when normalised and lower-cased one by one, so that whatever stands
    beside the word can't join it. The dotted capital I doesn't: its small form ends in a combining mark."""
    if not word.isalpha():
        return False
    return word.isascii() or (max(word) < "ɐ" and "İ" not in word and unicodedata.is_normalized("NFC", word))


class WordCache(dict):
    """piece -> ids as little-endian uint16 bytes; cleared when it holds `limit` pieces."""

    def __init__(self, path: str, limit: int = 400_000):
        super().__init__()
        self.tok = load_tokenizer(path)
        self.merge = merge_core(path).encode_single_piece
        self.limit = limit
        self.n_vocab = self.tok.get_vocab_size(with_added_tokens=True)
        if self.n_vocab > 65_536:
            raise ValueError("ids must fit in 16 bits")

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self._encode(piece)
        if len(piece) <= 64:
            self[piece] = out
        return out

    def _encode(self, piece: str) -> bytes:
        if plain_letters(piece):
            return array("H", self.merge(piece.lower().encode() + b"\xff")).tobytes()
        if (m := _LETTERS_MARK.fullmatch(piece)) and plain_letters(m[1]) and "<|" not in m[2]:
            return self[m[1]] + self[m[2]]
        return self.library(piece)

    def library(self, text: str) -> bytes:
        """Ids by the library's whole pipeline."""
        return array("H", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as the library's encode(text, add_special_tokens=False) gives them."""
        pieces = text.split() if not _ODD.search(text) else [p for p in _SPACE.split(text) if p]
        return b"".join(map(self.__getitem__, pieces))

    def tokens(self) -> list[str]:
        return [self.tok.id_to_token(i) or "" for i in range(self.n_vocab)]


def word_cache(path: str) -> WordCache:
    """One per Python worker and vocabulary, kept between tasks."""
    return held("words", path, lambda: WordCache(path))
