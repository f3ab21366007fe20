"""The byte-level BPE shared by operators 2 and 3, loaded once in each Python worker.

Ids are those of the tokenizers library. Texts of printable Latin characters go through tiktoken with the
same merges (about six times as fast); all others, whose character classes the two libraries might see
differently, go through tokenizers itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np

PLAIN = re.compile(r"[\t\n\r -~¡-ȳ]*\Z")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """encode(text) -> uint32 ids; decode(ids) -> text; ids_of_tokens' byte lengths in .width."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding()
        self.slow.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, special = _byte_chars(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(map(chars.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes_of.items()}, special_tokens=special)
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.width = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.width[i] = len(b)
        self.decimal = [str(i) for i in range(len(self.width))]
        self.special = set(special)

    def encode(self, text: str) -> np.ndarray:
        if PLAIN.match(text):
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=self.special), np.uint32)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)
