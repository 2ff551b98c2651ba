"""Token ids as the tokenizers library gives them for a byte-level vocabulary.

Lengths come from batch calls of the library that a file belongs to. For ids, the rank file of
the same vocabulary encodes the texts whose characters every Unicode version classes alike
(below U+0250); all others, and files without a rank file beside them, go through the library.
"""

from __future__ import annotations

import base64
import functools
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

DEFAULT = "byte_bpe_50k.json"
_UNUSUAL = re.compile("[ɐ-\U0010ffff]")
# Letters and digits that every Unicode version has, and marks that end a clause.
_LETTER = "0-9A-Za-zÀ-ÖØ-öø-ʯЀ-ҁҊ-ӿぁ-ゖァ-ヺ一-龥가-힣"
_MARK = ",.;:!?、。，；：！？"
#: A space between ASCII letters or digits, and a mark after a letter: every pre-tokeniser here breaks before these.
_SAFE = re.compile(f"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])|(?<=[{_LETTER}])(?=[{_MARK}])")


def vocabulary_path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text) and count(text) for one vocabulary file, without added begin or end tokens."""

    def __init__(self, name: str = DEFAULT):
        self.path, self.special = vocabulary_path(name), {}
        ranks = re.sub(r"\.json$", ".tiktoken", self.path)
        self._fast = self._slow = self._pieces = None
        if self.path.endswith(".model"):
            import sentencepiece

            self._pieces = sentencepiece.SentencePieceProcessor(model_file=self.path)
        elif self.path.endswith(".json"):
            import json

            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.no_truncation()
            self._slow.no_padding()
            with open(self.path) as f:
                spec = json.load(f)
            added = spec.get("added_tokens") or []
            self.special = {x["content"]: x["id"] for x in added}
            byte_level = (spec.get("pre_tokenizer") or {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added)
            if byte_level and plain and spec.get("normalizer") is None and os.path.exists(ranks):
                self._fast = _rank_encoding(ranks)
        else:
            self._fast = _rank_encoding(self.path)
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def ids(self, text: str) -> list[int]:
        if self._pieces is not None:
            return self._pieces.encode(text)
        if self._fast is None or (self._slow is not None and _UNUSUAL.search(text)):
            return self._slow.encode(text, add_special_tokens=False).ids
        if self._split is None or not self._split.search(text):
            return self._fast.encode_ordinary(text)
        out: list[int] = []
        for part in self._split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._fast.encode_ordinary(part)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """How many ids each text has, by one batch call (without offsets) of the library that the file belongs to."""
        if self._pieces is not None:
            return [len(x) for x in self._pieces.encode(texts, num_threads=1)]
        if self._slow is None:
            return [len(x) for x in self._fast.encode_ordinary_batch(texts, num_threads=1)]
        return [len(e) for e in self._slow.encode_batch_fast(texts, add_special_tokens=False)]


def _rank_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def encoder(name: str = DEFAULT) -> Encoder:
    return Encoder(name)


def safe_parts(text: str, most: int) -> list[str]:
    """The text in parts of about `most` characters whose tokens, joined, are the text's own.

    Cuts only before a space between two ASCII letters or digits, and before a mark such as a
    comma or an ideographic full stop after a letter, where a byte-level or word-level
    pre-tokeniser ends a word whatever stands around; without such a place (one word, say) the
    text stays whole.
    """
    parts, at = [], 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]
