"""Token ids of whole texts by a public byte-level BPE vocabulary file."""

from __future__ import annotations

import json

import numpy as np

#: The pre-tokenizer of byte-level BPE files that have `use_regex` set.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_characters() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """The ids that the `tokenizers` library gives for a byte-level BPE file, add_special_tokens=False.

    Text that spells a special token gets that token's id, as there, unless
    encode() is told that it is ordinary text (encode_special_tokens there).

    In these files a merged token's id grows with the place of its merge, so the
    ids serve as merge ranks and a rank-based encoder gives the same ids, three
    times as fast; the tests compare the two on every code point.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        byte = _bytes_of_characters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.vocabulary_size = max([*spec["model"]["vocab"].values(), *special.values()]) + 1

    def encode(self, text: str, special: bool = True) -> np.ndarray:
        """special: whether spelled special tokens are found."""
        return self.encoding.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=()).astype(np.uint32, copy=False)


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """The encoder of a file, kept for the life of a Python worker."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]
