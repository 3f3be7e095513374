"""Token ids of whole texts by a public vocabulary file of the tokenizers library.

The vocabulary's splitter parts a text into words, runs of signs, and digits, none of
which spans white space. So the ids of a text are the ids of those parts in a row,
and they can be remembered. A text of Latin letters, digits, signs (no apostrophe) and
blanks is parted here; only new words go through the library, many at a time: the last
id of each is one that ends a word. Any other text is cut at its blanks only
(canonical composition never joins across a blank, lower-casing is by code point)
and its new stretches go through the library whole. Both memories are bounded and keep
what was used last.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

# Fixed classes: none of these characters is changed by canonical composition.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f"[{LETTERS}{SIGNS}0-9 \\t\\n\\r]*")
WORDS = re.compile(f"[{LETTERS}]+|[{SIGNS}]+|[0-9]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory:
    """Two generations of a mapping: what was used since the last turn, and before it."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def fill(self, keys: set[str], make: Callable[[list[str]], dict[str, bytes]]) -> dict[str, bytes]:
        """A mapping that holds all of keys."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        missing = keys.difference(self.new)
        again = missing.intersection(self.old)
        self.new.update(zip(again, map(self.old.__getitem__, again), strict=True))
        missing -= again
        if missing:
            self.new.update(make(list(missing)))
        return self.new


class Encoder:
    def __init__(self, path: str, remembered: int = 300_000, together: int = 500):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self._np, self._model, self._together = np, Tokenizer.from_file(path), together
        self._stretches, self._words = Memory(remembered), Memory(remembered)
        tokens = self._model.get_vocab()
        self._ends = np.zeros(max(tokens.values()) + 1, dtype=bool)
        special = [re.escape(t.content) for t in self._model.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(special) or r"(?!)")  # these are ids of their own
        self._ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True

    @property
    def vocabulary(self) -> int:
        return self._model.get_vocab_size()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        out: list[bytes] = []
        texts = [t or "" for t in texts]
        for at in range(0, len(texts), 1000):
            parts, plain = [], []
            for t in texts[at : at + 1000]:
                plain.append(PLAIN.fullmatch(t) is not None and not self._special.search(t))
                parts.append(WORDS.findall(t.lower()) if plain[-1] else t.replace("\n", " ").split(" "))
            words = self._words.fill(set().union(*(p for p, ok in zip(parts, plain, strict=True) if ok)), self._new_words)
            stretches = self._stretches.fill(set().union(*(p for p, ok in zip(parts, plain, strict=True) if not ok)), self._whole)
            out += [b"".join(map((words if ok else stretches).__getitem__, p)) for p, ok in zip(parts, plain, strict=True)]
        return out

    def _whole(self, stretches: list[str]) -> dict[str, bytes]:
        found = self._model.encode_batch_fast(stretches, add_special_tokens=False)
        return {s: self._np.array(x.ids, "<u4").tobytes() for s, x in zip(stretches, found, strict=True)}

    def _new_words(self, words: list[str]) -> dict[str, bytes]:
        np, out = self._np, {}
        groups = [words[at : at + self._together] for at in range(0, len(words), self._together)]
        for group, found in zip(groups, self._model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(group):  # this vocabulary parts words otherwise
                out |= self._whole(group)
                continue
            raw, start = ids.tobytes(), 0
            for word, end in zip(group, (4 * ends).tolist(), strict=True):
                out[word] = raw[start:end]
                start = end
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    return Encoder(path)
