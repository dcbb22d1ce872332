"""Token ids of the public byte-level BPE vocabularies.

The rank file and the JSON file of a vocabulary give the same ids; encoding by
ranks is about six times as fast, so it is used wherever a rank file lies
beside the JSON file. Texts that hold the string of a special token, or that
the fast encoder refuses, go through the tokenizers library. A rank file can be
named itself; it has no special tokens.
"""

from __future__ import annotations

import base64
import functools
import json
import os
from collections.abc import Callable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name_or_path: str = VOCABULARY) -> str:
    """A path as it is; a bare name is looked up among the installed public
    vocabularies, on the machine that asks."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@functools.cache
def _library(path: str) -> Callable[[str], list[int]]:
    """The tokenizers library, which takes 30 MB: loaded once a text needs it."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    return lambda text: exact.encode(text, add_special_tokens=False).ids


def _special(path: str) -> list[str]:
    """The strings of a vocabulary's special tokens, without reading the rest."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    key = '"added_tokens"'
    at = text.find(key)
    start = text.find("[", at + len(key)) if at >= 0 else -1
    if start < 0 or text[at + len(key) : start].strip() != ":":
        return []
    return [t["content"] for t in json.JSONDecoder().raw_decode(text, start)[0]]


@functools.cache
def encoder(name_or_path: str = VOCABULARY) -> Callable[[str], list[int]]:
    """text -> ids, without special tokens added. Cached in each process."""
    path = vocabulary_path(name_or_path)
    if path.endswith(".tiktoken"):
        fast = _ranked(path)
        return lambda text: fast.encode_ordinary(text)
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(ranks):
        return _library(path)
    special = _special(path)
    fast = _ranked(ranks)

    def encode(text: str) -> list[int]:
        if not any(s in text for s in special):
            try:
                return fast.encode_ordinary(text)
            except ValueError:  # over the matcher's limits
                pass
        return _library(path)(text)

    return encode
