"""Public tokenizers inside Python workers, loaded once per process.

``load(path)`` gives an object with ``ids(text) -> numpy uint32`` that equals
the library the file belongs to (``.json``: tokenizers without added special
tokens; ``.model``: sentencepiece without begin and end).

A ``.json`` file that is plain byte-level BPE (no normaliser, the usual split
pattern, merges in id order: checked when loading) runs through tiktoken's
encoder, built from the file's own vocabulary, which gives the same ids
several times faster; texts with a very long run without a break go through
tokenizers, whose merge loop doesn't slow down on them.  Any other file runs
through its own library only.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import public_tokenizers

LONG_TEXT = 20_000  # characters: only longer texts are looked through for long runs
LONG_RUN = re.compile(r"\S{5000}|\s{5000}")


def public_path(name: str) -> str:
    return public_tokenizers.path(name)


def version_of(path: str) -> str:
    """Digest of the file and its library's version."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        h.update(f.read())
    if path.endswith(".json"):
        import tokenizers
        h.update(f"tokenizers {tokenizers.__version__}".encode())
    else:
        import sentencepiece
        h.update(f"sentencepiece {sentencepiece.__version__}".encode())
    return h.hexdigest()


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in own}
    for i, b in enumerate(b for b in range(256) if b not in set(own)):
        letters[chr(256 + i)] = b
    return letters


def _byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """token bytes -> id, if ids in merge order make tiktoken equal to it."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
             and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("dropout")
             and not model.get("ignore_merges") and not spec.get("truncation") and not spec.get("padding")
             and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])
                     for t in spec["added_tokens"]))
    if not plain:
        return None
    vocab = model["vocab"]
    last = 255
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        if vocab.get(a + b, -1) <= last:
            return None
        last = vocab[a + b]
    letter = _byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(letter[c] for c in t): i for t, i in vocab.items() if t not in special}


class _Json:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _byte_level_ranks(spec)
        self.fast = None
        if ranks:
            import tiktoken
            self.fast = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or (len(text) > LONG_TEXT and LONG_RUN.search(text)):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


class _Piece:
    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)


@functools.cache
def load(path: str):
    return _Json(path) if path.endswith(".json") else _Piece(path)
