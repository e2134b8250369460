"""Tokenizer files in the tasks: loading, and memos that live as long as a Python worker."""

from __future__ import annotations

import os
import re

#: Entries of a memo before it starts anew; about 150 bytes each.
MEMO = 1_200_000

_loaded: dict[str, object] = {}
_memos: dict[tuple[str, str], dict] = {}

#: What \s is for the tokenizers; between such characters no token reaches.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words with the one blank before them, and runs of white space: no byte-level pre-token crosses their edges.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Beyond the range in which LATIN knows letters, numbers and white space.
WIDE = re.compile("[\\u0180-\\U0010ffff]")
_L, _N, _S = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"
#: The byte-level pre-tokens of texts without WIDE characters.
LATIN = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: The lower-case word pre-tokens of lower-cased texts without WIDE characters or a dotted capital I (two characters in lower case).
LATIN_WORD = re.compile(f"[{_L}]+|'(?:[stmd]|re|ve|ll)|[{_N}]|[^{_S}{_L}{_N}]+")
WIDE_OR_DOTTED = re.compile("[\\u0130\\u0180-\\U0010ffff]")
#: Words between ASCII white space.
WORD = re.compile(r"[^ \t-\r]+")


def load(path: str):
    """The tokenizer of a .json file, one instance a process and a single thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def memo(path: str, use: str) -> dict:
    """A dictionary for one use of one tokenizer, emptied once it is large."""
    kept = _memos.setdefault((path, use), {})
    if len(kept) > MEMO:
        kept.clear()
    return kept


def ids_of(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def special_texts(tokenizer) -> list[str]:
    """Added tokens, which are found in a text before anything else."""
    return sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)


def is_byte_level(tokenizer) -> bool:
    """Whether pre-tokens are those of the byte-level pattern, and nothing is normalised."""
    import json

    parts = json.loads(tokenizer.to_str())
    pre = parts["pre_tokenizer"] or {}
    return parts["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def is_lower_word_level(tokenizer) -> bool:
    """Whether texts are composed, lower-cased and cut into words, numbers and signs, each closed by a piece with an end mark."""
    import json

    parts = json.loads(tokenizer.to_str())
    norm = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
    pre = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    cut = [x.get("pattern", {}).get("Regex") for x in pre[:1]]
    return norm == ["NFC", "Replace", "Lowercase"] and cut == [
        "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    ] and len(pre) == 2 and not pre[1].get("use_regex") and parts["model"].get("end_of_word_suffix") == "</w>"


def closing_ids(tokenizer):
    """For each id, whether its piece ends a word."""
    import numpy as np

    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    for piece, i in vocabulary.items():
        ends[i] = piece.endswith("</w>")
    return ends
