"""Token ids of single words, for the operators that count, pack and encode.

A tokenizer is sent to the tasks as the text of its file. Words that a task has encoded stay in a
bounded cache of its Python worker. Texts in which a word could depend on what stands around it
(special strings, separators that the two libraries class differently) are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

#: Python's split() takes these for white space, the tokenizers library does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"

_LOADED: dict[int, object] = {}


def load(text: str):
    """The tokenizer whose file holds ``text``, once per worker; no truncation, no padding."""
    key = hash(text)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(text)
        made.no_truncation()
        made.no_padding()
        _LOADED[key] = made
    return _LOADED[key]


#: The split that byte-level files name by ``use_regex``. Fixed value.
BYTE_LEVEL_SPLIT = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)


def byte_alphabet() -> dict[str, int]:
    """Byte-level files write each byte as one printable character: itself, or one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


def rank_encoder(text: str) -> Callable[[str], list[int]] | None:
    """A faster encoder with the same ids, for byte-level files whose ids are the ranks of their merges.

    None where the file is of another kind: then the tokenizers library itself must be asked.
    """
    file = json.loads(text)
    step, model = file.get("pre_tokenizer") or {}, file["model"]
    if file.get("normalizer") or step.get("type") != "ByteLevel" or not step.get("use_regex"):
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    vocabulary = model["vocab"]
    if step.get("add_prefix_space") or model.get("ignore_merges") or model.get("end_of_word_suffix"):
        return None
    if any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    import tiktoken

    alphabet, special = byte_alphabet(), set(special_strings(text))
    ranks = {bytes(alphabet[c] for c in piece): k for piece, k in vocabulary.items() if piece not in special}
    made = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return made.encode_ordinary


def special_strings(text: str) -> list[str]:
    """The strings that the tokenizer takes out of a text before it splits words."""
    return [token["content"] for token in json.loads(text)["added_tokens"]]


def splits_at_white_space(text: str) -> bool:
    """Whether the tokenizer drops all white space, so that words are encoded on their own."""
    step = json.loads(text).get("pre_tokenizer") or {}
    first = (step.get("pretokenizers") or [step])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))


class Words(dict):
    """A cache of ``make(word)`` with two generations of at most ``room`` words each.

    The older generation is dropped when the newer is full; a word that is found in it moves over.
    """

    def __init__(self, make: Callable[[str], object], room: int = 400_000):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def forget(self) -> None:
        """Drop all words of both generations."""
        self.clear()
        self.old = {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value
