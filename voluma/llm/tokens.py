"""Token ids of whole texts by a public byte-level BPE vocabulary (a ``tokenizers`` JSON file)."""

from __future__ import annotations

import json
import os

import numpy as np

#: The pre-token pattern of the byte-level pre-tokeniser, and the same without its look-ahead, which only
#: matters where two white-space characters meet.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: White space other than the space and the line feed.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
MEETINGS = ("  ", " \n", "\n ", "\n\n")


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """``encode(text)`` gives the ids that ``Tokenizer.from_file(path)`` gives with add_special_tokens=False.

    A plain byte-level BPE file is run by tiktoken, whose ranks are the file's ids (several times faster); any other file by
    the tokenizers library itself.  With ``added_tokens`` the strings of the file's added tokens get their own ids, as the
    library does by default; without it they are ordinary text, as with its ``encode_special_tokens``.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = model["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        plain &= pre.get("use_regex", True) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        added = spec.get("added_tokens", [])
        plain &= not added_tokens or not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        self.other, self.added = None, [t["content"] for t in added] if added_tokens else []
        if plain:
            import tiktoken

            special = {t["content"]: t["id"] for t in added}
            bytes_of = _byte_chars()
            ranks = {bytes(bytes_of[c] for c in k): i for k, i in model["vocab"].items() if k not in special}
            self.exact = tiktoken.Encoding("exact", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special if added_tokens else {})
            self.quick = tiktoken.Encoding("quick", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens={})
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.other = Tokenizer.from_file(path)
            self.other.encode_special_tokens = not added_tokens

    def encode(self, text: str) -> np.ndarray:
        if self.other is not None:
            return np.array(self.other.encode(text, add_special_tokens=False).ids, np.uint32)
        if any(t in text for t in self.added):
            return np.array(self.exact.encode(text, allowed_special="all"), np.uint32)
        meets = any(m in text for m in MEETINGS) or any(c in text for c in OTHER_SPACE)
        return np.array((self.exact if meets else self.quick).encode_ordinary(text), np.uint32)
