"""Splitting a text into special strings and pre-tokens exactly as a tokenizers file does.

Plain Latin text is split by a compiled pattern; a text with other characters is normalised and split by the file's own components, since
libraries differ in their Unicode tables.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# In texts without these, letters and numbers are the classes below in every Unicode table, and lowering is the same one character at a time.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa0-ɏ]")
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)}


class Splitter:
    """``split(text)`` gives (special id, None) and (None, [pre-tokens]) runs of a text in order."""

    def __init__(self, path: str, pattern: str, fold: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = re.compile(pattern).findall
        self.fold = fold
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.back = {c: b for b, c in byte_alphabet().items()}

    def plain(self, text: str) -> list[str]:
        if UNUSUAL.search(text) is None:
            if not self.fold:
                return self.find(text)
            lowered = text.lower()
            if text.isascii() or UNUSUAL.search(lowered) is None:
                return self.find(lowered)
        t = self.tokenizer
        normal = t.normalizer.normalize_str(text) if t.normalizer else text
        back = self.back
        return [bytes(back[c] for c in piece).decode("utf-8") for piece, _ in t.pre_tokenizer.pre_tokenize_str(normal)]

    def split(self, text: str):
        if "<|" not in text:
            yield None, self.plain(text)
            return
        for part in self.cut.split(text):
            if part in self.special:
                yield self.special[part], None
            elif part:
                yield None, self.plain(part)
