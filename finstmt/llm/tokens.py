"""Token ids from public vocabulary files; the files' path is a parameter, nothing is trained."""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: A fixed value: the JSON file's special token, whose string in a text is this id, as it is for that file's own tokenizer.
SPECIAL = {"<|endoftext|>": 50256}
BPE_JSON, BPE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@functools.lru_cache(4)
def _json(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def _ranks(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def ids(text: str | None, ranks: str | None = None, slow: str | None = None) -> list[int]:
    """Ids of the byte-level vocabulary (null: none).

    The rank file gives the ids of the JSON file several times as fast; a text on which its splitter gives up
    (such as megabytes of white space) goes to the JSON tokenizer.
    """
    if not text:
        return []
    try:
        return _ranks(ranks or public_tokenizers.path(BPE_RANKS)).encode(text, allowed_special="all")
    except BaseException as e:
        if type(e).__name__ != "PanicException":  # the library's panics are no Exceptions and cannot be imported
            raise
        return _json(slow or public_tokenizers.path(BPE_JSON)).encode(text, add_special_tokens=False).ids


def vocabulary_size() -> int:
    return _json(public_tokenizers.path(BPE_JSON)).get_vocab_size()


def packed(values: list[int], end: int | None = None) -> np.ndarray:
    """Two bytes an id; the vocabulary here has 50,257."""
    return np.array(values if end is None else [*values, end], "<u2")
