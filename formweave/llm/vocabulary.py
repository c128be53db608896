"""Vocabulary files of public tokenizers, read once on the driver and sent with the tasks.

A file is at most a few MB whatever the data are.  The path is a parameter.
"""

from __future__ import annotations

import base64
import json
import re
from pathlib import Path

#: What words are for byte-level vocabularies; fixed by the vocabularies' tokenizers.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def plain_specials(spec: dict) -> dict[str, int]:
    """Special strings that are looked for in raw text, with their ids."""
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"not supported: {t}")
    return {t["content"]: t["id"] for t in spec["added_tokens"]}


def read_ranks(path: str) -> dict[bytes, int]:
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _spelt_out(pattern: str) -> str | None:
    """pattern for `re`, its classes as ranges of characters up to U+FFFF; None if it has escapes other than \\p{..}, \\s and \\S."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    ranges = {
        kind: "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(f"{kind}+", every))
        for kind in set(re.findall(r"\\p\{\w+\}|\\s", pattern.replace(r"\S", r"\s")))
    }
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part == r"\S" and not inside:
            part = f"[^{ranges[r'\s']}]"
        elif part in ranges:
            part = ranges[part] if inside else f"[{ranges[part]}]"
        elif part.startswith("\\"):
            return None
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return "".join(out)


def finder(pattern: str):
    """text -> all matches of pattern, as regex.findall gives them.

    `re` takes half the time, but knows no \\p{..}: it gets the characters that
    `regex` counts to each class, and only texts up to U+FFFF, where its sets are fast.
    """
    import regex

    find, plain = regex.compile(pattern).findall, _spelt_out(pattern)
    if plain is None:
        return find
    fast, beyond = re.compile(plain).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: find(text) if not text.isascii() and beyond(text) else fast(text)


class WordCache(dict):
    """make(word) of each word, remembered for up to `most` words at a time."""

    def __init__(self, make, most: int = 400_000):
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.make(word)
        return out
