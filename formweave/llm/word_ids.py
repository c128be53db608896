"""Token ids of whole texts by a word-wise BPE tokenizer, each distinct word once.

Texts are normalised and cut into words here, the tokenizers library's model
turns a word into ids, and words met before are looked up.  The result is
that of the library on the whole text; it was several times slower there,
for most of its time goes into tracking positions that are not asked for.
"""

from __future__ import annotations

import json
import re
import unicodedata
from struct import pack

from formweave.llm.vocabulary import WordCache, byte_letters, finder, plain_specials

#: The only chain of steps that is known here, as the vocabulary's file states it.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def encoder(spec: dict):
    """text -> ids as little-endian unsigned 32-bit integers in bytes, without special tokens of its own."""
    from tokenizers import Tokenizer

    split, level = spec["pre_tokenizer"]["pretokenizers"]
    known = (
        [n["type"] for n in spec["normalizer"]["normalizers"]] == NORMALIZERS
        and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]
        and level["type"] == "ByteLevel" and not level["use_regex"] and not level["add_prefix_space"]
    )
    if not known:
        raise ValueError("not a tokenizer of lower-case words")
    tokenize = Tokenizer.from_str(json.dumps(spec)).model.tokenize
    letters = str.maketrans({chr(b): letter for b, letter in byte_letters().items()})

    def ids(word: str) -> bytes:
        # printable ASCII stands for itself
        plain = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(letters)
        found = [t.id for t in tokenize(plain)]
        return pack(f"<{len(found)}I", *found)

    find = finder(split["pattern"]["Regex"])
    numbers = plain_specials(spec)
    cut = re.compile(f"({'|'.join(map(re.escape, numbers))})" if numbers else r"(?!)").split
    look = WordCache(ids).__getitem__

    def words(text: str) -> list[str]:
        if not text.isascii():
            # lower() of a whole text would choose the sigma by its place in the word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return find(text.lower())

    def encode(text: str) -> bytes:
        parts = cut(text)
        out = [b"".join(map(look, words(parts[0])))]
        for special, rest in zip(parts[1::2], parts[2::2], strict=True):
            out += [pack("<I", numbers[special]), *map(look, words(rest))]
        return b"".join(out)

    return encode
