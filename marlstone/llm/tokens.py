"""Token ids of a public byte-level BPE vocabulary.

The vocabulary is read as ranks, whose ids equal those of the JSON file beside it. tiktoken encodes; the JSON's added
tokens are recognised in text as ``tokenizers`` does, and what stands between them is encoded by itself. Encoding whole texts was measured faster than looking words up: most distinct
words are rare, and a rare word costs more by itself than inside its text.

The pattern's last alternatives, white space that no other character follows and then any white space, differ from white space alone only in a run of two or more before
another character, whose last one they leave to what follows. Looking ahead costs a third of the time of encoding, so texts are cut before that last one
and encoded without it; a text that holds an added token, which ends a run as well, is encoded whole by the full pattern.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np

LOOKS_AHEAD, ANY_WHITE = r"|\s+(?!\S)|\s+", r"|\s+"
#: White space as Unicode has it, and tiktoken's ``\s``; in UTF-8 bytes the ASCII ones become spaces, by which most texts are told to have no run.
WIDE_WHITE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TO_SPACES = bytes(0x20 if c in b"\t\n\v\f\r " else c for c in range(256))
#: A run of two or more before another character, but for its last one.
RUN = re.compile(r"[{0}]+(?=[{0}][^{0}])".format(r"\t-\r " + WIDE_WHITE))


def cuts(text: str) -> list[int]:
    """Where runs of two or more white-space characters leave the last one to the character that follows."""
    if b"  " in text.encode().translate(TO_SPACES) or not text.isascii() and any(c in text for c in WIDE_WHITE):
        return [m.end() for m in RUN.finditer(text)]
    return []


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokenizer:
    """Encodes texts to little-endian ids of two bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with single_word, lstrip, rstrip or normalized are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        ranks = {k: v for k, v in ranks.items() if v not in self.added.values()}

        def encoder(pattern: str):
            return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added).encode_to_numpy

        self.whole, self.plain = encoder(public_tokenizers.PATTERN), None
        if public_tokenizers.PATTERN.endswith(LOOKS_AHEAD):
            self.plain = encoder(public_tokenizers.PATTERN.removesuffix(LOOKS_AHEAD) + ANY_WHITE)

    def encode(self, text: str) -> np.ndarray:
        if self.plain is None or any(t in text for t in self.added):
            return self.whole(text, allowed_special="all")
        ends = cuts(text)
        if not ends:
            return self.plain(text, disallowed_special=())
        return np.concatenate([self.plain(text[a:b], disallowed_special=()) for a, b in zip([0, *ends], [*ends, len(text)], strict=True)])

    def ids(self, text: str | None) -> bytes:
        """The ids of a text; none for null."""
        return self.encode(text).astype("<u2").tobytes() if text else b""


_made: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each Python worker."""
    if path not in _made:
        _made[path] = Tokenizer(path)
    return _made[path]
