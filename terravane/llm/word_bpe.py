"""Word-end BPE vocabularies (lower case, white space dropped), encoded chunk by chunk.

A chunk is a text's part between white space; its tokens depend on nothing else, so each is encoded once
and remembered, up to a bound of remembered chunks. What Unicode says of a character (its class, its lower case,
how it composes) differs between the versions of Python and of the tokenizers library, so chunks that
are not ASCII get their normal form and their pre-tokens from the library's own normaliser and splitter. For
letters on which both are found to agree (of the Latin, Greek and Cyrillic blocks) Python's functions do.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

#: White space as the vocabulary's patterns have it; Python's also has U+001C to U+001F.
WHITE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
_split_white, _separators = re.compile(WHITE).split, re.compile("[\\x1c-\\x1f]").search
#: Remembered chunks per Python worker.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Remembered(dict):
    """A dict that computes what it lacks and forgets everything once it is full."""

    def __init__(self, make: Callable[[str], object], most: int = REMEMBERED) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str) -> object:
        if len(self) >= self.most:
            self.clear()
        self[key] = x = self.make(key)
        return x


class WordBpe:
    """The vocabulary of a tokenizer file: its pre-tokens, merges and special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(model["merges"])}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern.replace("\\s", WHITE[1:-2])).findall
        self.specials = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.normal = Remembered(self.library.normalizer.normalize_str)
        self.agreed = re.compile(f"[\\x00-\\x7f{''.join(filter(self.agrees, map(chr, range(0xC0, 0x530))))}]*").fullmatch

    def agrees(self, c: str) -> bool:
        """Whether Python has a letter as the library has it: its lower case, its normal form, whatever stands around it, and its class."""
        same = self.library.normalizer.normalize_str(c) == c.lower() and unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c)
        return same and c != "Σ" and len(self.library.pre_tokenizer.pre_tokenize_str(f"a{c}a")) == 1 == len(self.find(f"a{c}a"))

    def chunks(self, text: str) -> list[str]:
        """The normalised chunks of a text without special strings."""
        if _separators(text):
            parts = [x for x in _split_white(text) if x]
        elif text.isascii():
            return text.lower().split()
        else:
            parts = text.split()
        return [x.lower() if x.isascii() or self.agreed(x) else self.normal[x] for x in parts]

    def words(self, chunk: str) -> list[str]:
        """The pre-tokens of a normalised chunk."""
        if chunk.isascii() or self.agreed(chunk):
            return self.find(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def symbols(self, word: str) -> list[str]:
        s = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        s[-1] += self.end
        return s

    def merge(self, s: list[str]) -> list[str]:
        """The tokens of one pre-token: the pair of least rank first, leftmost first."""
        rank = self.ranks.get
        if len(s) > 64:
            return self.merge_long(s)
        while len(s) > 1:
            best, at = min((rank(p, 1 << 30), k) for k, p in enumerate(zip(s, s[1:])))
            if best == 1 << 30:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def merge_long(self, s: list[str]) -> list[str]:
        """The same with a queue and links, for pre-tokens of any length."""
        n, rank = len(s), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k, s[k], s[k + 1]) for k in range(n - 1) if (r := rank((s[k], s[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            j = after[k]
            if s[k] != a or j >= n or s[j] != b:
                continue
            s[k], s[j] = a + b, ""
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and (y := after[x]) < n and (r := rank((s[x], s[y]))) is not None:
                    heapq.heappush(queue, (r, x, s[x], s[y]))
        return [x for x in s if x]

    def tokens(self, word: str) -> list[str]:
        return self.merge(self.symbols(word))

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """(chunks, special ids) of a text, for counts."""
        if "<" not in text or not (found := self.specials.findall(text)):
            return self.chunks(text), []
        return [c for part in self.specials.split(text) for c in self.chunks(part)], [self.special[x] for x in found]
