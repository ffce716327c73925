"""Token ids of a public byte-level vocabulary.

The vocabulary file is the tokenizers library's JSON. Its merges are handed to tiktoken, whose
encoder gives the same ids several times faster (tests compare the two); a text that holds one
of the vocabulary's special strings goes to the tokenizers library itself."""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: the splitting pattern of this family of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_kept: dict[str, tuple] = {}


def byte_of_letter() -> dict[str, int]:
    """The letters by which such vocabularies write bytes: printable bytes stand for themselves, others count up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load(path: str) -> tuple:
    if path not in _kept:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        _kept[path] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(path), special
    return _kept[path]


class Encoder:
    def __init__(self, path: str):
        self.fast, self.plain, self.special = load(path)

    def __call__(self, text: str, end_id: int | None = None) -> np.ndarray:
        """Ids as uint32, then end_id if there is one."""
        if any(s in text for s in self.special):
            ids = self.plain.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids if end_id is None else [*ids, end_id], np.uint32)
