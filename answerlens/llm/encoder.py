"""Token ids of texts by a tokenizer file, with a bounded word cache.

The tokenizer never lets a token span white space, so a text is split there and every distinct word goes through the
tokenizer once while it stays in the cache. Lower-casing A-Z beforehand is safe only for a tokenizer that lower-cases
and for texts without characters that combine; other texts keep their case. With the rules of ``_RULES``, punctuation
after a letter or digit is a token run of its own, so it is looked up on its own; and a word of Latin letters alone is one
run that only has its case changed, so it goes to the tokenizer's merges directly.
"""

from __future__ import annotations

import json
import os
import re
import string
from functools import partial

import numpy as np

_BEYOND_LATIN = re.compile("[^\u0000-˿]")
# About 250 bytes a word.
CACHE_WORDS = 700_000
# Letters that no normal form changes and whose lower case is one letter, which leaves out U+0130.
_LETTERS = "".join(c for c in map(chr, range(0x300)) if c.isalpha() and c.lower().isalpha())
_PLAIN = re.compile(f"[{_LETTERS}]+")
_ENDS = frozenset(_LETTERS + string.digits)
_WORD_END = "</w>"
# How the public tokenizer prepares a text for the merges: normal form, lower case, runs of letters, single digits, runs of
# the rest, bytes.
_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts; one instance per worker. ``cache_words`` bounds its memory, never its results."""

    def __init__(self, path: str, end_id: int = 1, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.cache_words = cache_words
        self.cache: dict[bytes, bytes] = {}
        self.tails, self.merges, self.byte_merges, self.closes = b"", None, None, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if self._known(spec):
            self.tails = "".join(set(string.punctuation).difference(*(t["content"] for t in spec["added_tokens"]))).encode()
            lines, in_bytes = pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.merges, self.byte_merges = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer, self.byte_merges.pre_tokenizer = lines, pre_tokenizers.Sequence([lines, in_bytes])
            self.closes = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.closes[[i for token, i in spec["model"]["vocab"].items() if token.endswith(_WORD_END)]] = True

    @staticmethod
    def _known(spec: dict) -> bool:
        """Whether words of letters go to the merges as they are, and the last token of each is one that closes a word."""
        from tokenizers import pre_tokenizers

        model = spec["model"]
        return (
            all(spec[key] == rule for key, rule in _RULES.items())
            and model["type"] == "BPE"
            and model.get("end_of_word_suffix") == _WORD_END
            and not model.get("ignore_merges")
            and all(c + end in model["vocab"] for c in pre_tokenizers.ByteLevel.alphabet() for end in ("", _WORD_END))
            and not any(_PLAIN.search(t["content"][:1]) for t in spec["added_tokens"])
        )

    @staticmethod
    def words(text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        if b"<|" not in raw and (text.isascii() or not _BEYOND_LATIN.search(text)):
            raw = raw.lower()
        return raw.split()

    def _cut(self, ids: list[int], ends: np.ndarray) -> list[bytes]:
        raw, start, out = np.array(ids, self.dtype).tobytes(), 0, []
        for end in (ends * self.dtype.itemsize).tolist():
            out.append(raw[start:end])
            start = end
        return out

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word alone, in one call of the tokenizer."""
        found = self.tokenizer.encode([w.decode("utf-8") for w in words], is_pretokenized=True, add_special_tokens=False)
        return self._cut(found.ids, np.bincount(np.array(found.word_ids, np.int64), minlength=len(words)).cumsum())

    def _merge(self, tool, words: list[bytes]) -> list[bytes]:
        """Ids of each word of lower-case letters alone, by the merges only."""
        (found,) = tool.encode_batch_fast([b"\n".join(words).decode("utf-8")], add_special_tokens=False)
        ids = found.ids
        return self._cut(ids, np.flatnonzero(self.closes[ids]) + 1)

    def _learn(self, missing: set[bytes]) -> None:
        """Put the ids of the words into the cache."""
        cache, tails = self.cache, self.tails
        plain, latin, other, split = set(), set(), set(), {}
        for word in missing if self.merges else ():
            core = word.rstrip(tails)
            if core.isalpha():
                low = core.lower()
                plain.add(low)
            else:
                text = core.decode("utf-8")
                if text[-1:] not in _ENDS:
                    core, text = word, word.decode("utf-8")
                if _PLAIN.fullmatch(text):
                    low = text.lower().encode("utf-8")
                    latin.add(low)
                else:
                    low = core
                    other.add(low)
            if low != word:
                tail = word[len(core) :]
                split[word] = low, tail
                other.add(tail)
        kinds = (plain, partial(self._merge, self.merges)), (latin, partial(self._merge, self.byte_merges)), (other, self._encode)
        for words, encode in kinds if self.merges else [(missing, self._encode)]:
            wanted = [w for w in words if w not in cache]
            for i in range(0, len(wanted), 20_000):
                part = wanted[i : i + 20_000]
                cache.update(zip(part, encode(part), strict=True))
        for word, (core, tail) in split.items():
            cache[word] = cache[core] + cache[tail]

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text with the end id, as bytes of ``self.dtype``."""
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        cut = [self.words(t) for t in texts]
        cache, missing = self.cache, set()
        for words in cut:
            missing.update(words)
        missing = missing.difference(cache)
        if missing:
            self._learn(missing)
        get = cache.__getitem__
        return [b"".join(map(get, words)) + self.end for words in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(raw, self.dtype) for raw in self.encode_raw(texts)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int = 1, cache_words: int = CACHE_WORDS) -> Encoder:
    """The encoder of this worker process; kept between tasks, as its cache is."""
    key = path, end_id, cache_words
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, end_id, cache_words)
    return _ENCODERS[key]


def in_blocks(texts, most_rows: int = 200, most_chars: int = 2_000_000):
    """Yield (first row, texts) blocks bounded in rows and characters; a longer text is a block of its own."""
    start, chars, block = 0, 0, []
    for text in texts:
        if block and (len(block) >= most_rows or chars + len(text) > most_chars):
            yield start, block
            start, chars, block = start + len(block), 0, []
        block.append(text)
        chars += len(text)
    if block:
        yield start, block
