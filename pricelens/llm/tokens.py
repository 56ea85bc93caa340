"""Token ids of whole texts with a public tokenizer file, inside Arrow tasks.

The tokenizer never merges across the start of a space that follows and
precedes other characters, so a text is the concatenation of its pieces there.
Pieces repeat; each worker keeps the ids of those it has met in a task (at most
``CACHE`` of them, then it starts anew). Texts with other white space around
a space are encoded whole.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Pieces that a worker keeps; about 250 bytes each.
CACHE = 450_000
#: Bytes of text that are split into pieces at a time; each piece is an object while it is.
SLICE = 1 << 21
IDS = np.dtype("<u4")
#: Pieces that are encoded as one text.
RUN = 512
#: How byte-level vocabularies write the space byte.
SPACE = "\u0120"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, the same as encoding each whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.first: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, cache: dict[str, bytes], pieces: set[str], spaced: bool) -> None:
        """Put the pieces' ids into ``cache``; not those with white space at an end, which no cut is safe beside."""
        new = [p for p in pieces if p not in cache and p and not p[0].isspace() and not p[-1].isspace()]
        if not spaced:
            cache.update(zip(new, self._encode(new), strict=True))
            return
        # Many pieces as one text: a piece has one space, at its start, so its ids begin at each id that begins with one.
        runs = [new[k:k + RUN] for k in range(0, len(new), RUN)]
        for run, encoded in zip(runs, self.whole.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype=IDS)
            at = (np.flatnonzero(self.begins[ids]) * IDS.itemsize).tolist()
            data = ids.tobytes()
            cache.update(zip(run, [data[x:y] for x, y in zip(at, [*at[1:], len(data)], strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        if len(self.first) + len(self.after) > CACHE:
            self.forget()
        self._learn(self.first, {s[0] for s in split}, False)
        rest: set[str] = set()
        for s in split:
            rest.update(s[1:])
        self._learn(self.after, rest, True)
        out: list[bytes | None] = []
        after = self.after.__getitem__
        odd = []
        for k, s in enumerate(split):
            try:
                out.append(b"".join([self.first[s[0]], *map(after, s[1:])]))
            except KeyError:  # white space beside a space: no safe piece
                odd.append(k)
                out.append(None)
        for k, ids in zip(odd, self._encode([texts[k] for k in odd]), strict=True):
            out[k] = ids
        return out


    def forget(self) -> None:
        """Give the pieces' memory back; a worker may go on to tasks of another kind."""
        self.first.clear()
        self.after.clear()


@lru_cache(None)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(texts: pa.Array, path: str, end: int) -> list[np.ndarray]:
    """Ids of every text (null: empty), each followed by the id ``end``."""
    tail = np.array([end], dtype=IDS).tobytes()
    return [np.frombuffer(ids + tail, dtype=IDS) for ids in encoder(path).encode(texts.fill_null("").to_pylist())]
