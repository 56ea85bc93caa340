"""SentencePiece ids of whole texts and back.

Method: merge-type prefix table. Every prefix of a text has one last token: of the
tokens that an automaton finds to end there, the one that is compatible with the
last token of the prefix before it. Two tokens are compatible if no merge over their border
would come before the merges that made them. The table holds that one token per prefix, and the ids are
read off backwards from the end.

The table is made for units: stretches between which no token reaches (from a space to the next,
and at control characters that no token holds). Units repeat, so a worker keeps the ids of those it has met,
across its tasks, in two generations of at most ``CACHE_BYTES`` each. Characters that the model lacks are bytes.

Defined results: null is the empty text, which has the begin and the end id only; literal names of control symbols are ordinary
text; a very long text is encoded in stretches of ``STRETCH`` characters that end between units, and decoded in slices
that end before a space; a long unit is tabled by itself and not kept; repeated rows give repeated results, a null doc_id stays null, no documents no rows. Only
doc_id and text are read. Models: byte-pair kind with byte fallback.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import text_docs
from .scan import slices

SPACE = "▁"
#: Characters of one stretch of a text; ids of one slice that is decoded.
STRETCH = 1 << 20
#: Bytes of units and ids that a worker keeps, and pairs of tokens whose compatibility it keeps.
CACHE_BYTES, PAIRS = 80 << 20, 1_000_000
#: Longer units are not kept.
LONG_UNIT = 64
#: What an entry costs beside its characters and ids.
ENTRY = 230
#: Text bytes handled at a time.
SLICE = 1 << 21
#: Control characters at which a text may be cut if no token holds them.
CONTROLS = "\n\t\r"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        pieces = {i: model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(model.is_byte, self.bytes)):
            raise ValueError("the model has no byte fallback")
        self.ids = {p: i for i, p in pieces.items()}
        falling = sorted({model.get_score(i) for i in pieces}, reverse=True)
        turn = {score: k for k, score in enumerate(falling)}
        #: When a token is merged: 0 is first, single characters are there from the start.
        self.turn = {i: -1 if len(p) == 1 else turn[model.get_score(i)] for i, p in pieces.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        #: For each token, whether the tokens met after it are compatible.
        self.after: dict[int, dict[int, bool]] = {}
        self.automaton = ahocorasick.Automaton()
        for i, p in sorted(pieces.items(), key=lambda x: self.turn[x[0]]):
            if len(p) > 1:
                made = self._made(p)
                if made is None:
                    continue  # no text is merged into this piece
                self.halves[i] = made
                if max(map(self.turn.__getitem__, made)) > self.turn[i]:
                    raise ValueError("a piece comes before its halves")
            self.automaton.add_word(p, (i, len(p), self.after.setdefault(i, {})))
        self.automaton.make_automaton()
        known = {c for p in self.ids for c in p}
        breaks = "".join(c for c in CONTROLS if c not in known)
        if any(SPACE in p.lstrip(SPACE) for p in pieces.values()):
            self.units = re.compile(f"[^{breaks}]+|[{breaks}]" if breaks else ".+", re.DOTALL)
            self.cuts = False
        else:
            self.units = re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (f"|[{breaks}]" if breaks else ""))
            self.cuts = True
        self.unknown = re.compile("([^" + re.escape("".join(sorted(known))) + "])")
        self.any = dict.fromkeys(self.after, True)
        self.pairs = 0
        #: Ids of the units met last, and of those met before; the latter go when the former are full.
        self.met: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.met_bytes = 0
        spaced = next(p for p in self.ids if p[0] == SPACE and len(p) > 1 and p[1] != SPACE)
        #: Does a text's first space belong to the model, not to the text?
        self.leading = model.decode([self.ids[spaced]]) == spaced[1:]
        self.spaced = np.array([i in pieces and pieces[i][0] == SPACE for i in ids])

    def _made(self, piece: str) -> tuple[int, int] | None:
        """The two tokens that become this piece when it stands alone, by merging in order."""
        try:
            parts = [self.ids[c] for c in piece]
        except KeyError:
            return None
        text = list(piece)
        while len(parts) > 2:
            found = [(self.turn[self.ids[x + y]], k) for k, (x, y) in enumerate(zip(text, text[1:], strict=False)) if x + y in self.ids]
            if not found:
                return None
            k = min(found)[1]
            text[k:k + 2] = [text[k] + text[k + 1]]
            parts[k:k + 2] = [self.ids[text[k]]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _fits(self, left: int, right: int) -> bool:
        """Would ``left`` and ``right`` stay apart? Any token at the border that meets another while both are there is merged if its turn comes first."""
        names, turn, halves = self._names, self.turn, self.halves
        x, until_x = left, None  # x is there until the turn of the token it becomes part of; ties go to the merge further left
        while True:
            y, until_y = right, None
            while True:
                both = self.ids.get(names(x) + names(y))
                if both is not None:
                    when = max(turn[both], turn[x], turn[y])
                    if (until_x is None or when < until_x) and (until_y is None or when <= until_y):
                        return False
                if y not in halves:
                    break
                y, until_y = halves[y][0], turn[y]
            if x not in halves:
                return True
            x, until_x = halves[x][1], turn[x]

    def _names(self, token: int) -> str:
        return self.model.id_to_piece(token)

    def _table(self, text: str) -> list[int]:
        """The ids of a stretch of known characters. Prefixes are numbered by their length; the empty one goes with every token."""
        last, size, after = [0] * (len(text) + 1), [0] * (len(text) + 1), [self.any] * (len(text) + 1)
        for end, (token, n, follow) in self.automaton.iter(text):
            end += 1
            if size[end]:
                continue
            fits = after[end - n].get(token)
            if fits is None:
                fits = self._learned(last[end - n], token)
            if fits:
                last[end], size[end], after[end] = token, n, follow
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _learned(self, left: int, right: int) -> bool:
        if self.pairs >= PAIRS:
            for follow in self.after.values():
                follow.clear()
            self.pairs = 0
        self.pairs += 1
        fits = self.after[left][right] = self._fits(left, right)
        return fits

    def _unit(self, unit: str) -> bytes:
        if not self.unknown.search(unit):
            return array("I", self._table(unit)).tobytes()
        out = array("I")
        for k, part in enumerate(self.unknown.split(unit)):
            if k % 2:
                out.extend(self.bytes[b] for b in part.encode())
            elif part:
                out.extend(self._table(part))
        return out.tobytes()

    def _stretches(self, text: str) -> Iterator[str]:
        """A normalized text in parts that end between units."""
        at = 0
        while self.cuts and len(text) - at > STRETCH:
            end = at + STRETCH
            while 0 <= end < len(text) and text[end - 1] == SPACE:
                end = text.find(SPACE, end + 1)
            if end < 0 or end >= len(text):
                break
            end = text.find(SPACE, end)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def _normalized(self, text: str) -> str:
        return self.model.normalize(text)

    def encode(self, text: str) -> np.ndarray:
        """All ids, the begin and the end id included."""
        out = [np.array([self.model.bos_id()], dtype="<u4").tobytes()]
        for stretch in self._stretches(self._normalized(text)) if text else ():
            units = self.units.findall(stretch)
            met = self.met
            try:
                out.append(b"".join(map(met.__getitem__, units)))
                continue
            except KeyError:
                pass
            for unit in set(units):
                if unit not in met and len(unit) <= LONG_UNIT:
                    ids = self.earlier.get(unit)
                    if ids is None:
                        ids = self._unit(unit)
                    met[unit] = ids
                    self.met_bytes += ENTRY + 2 * len(unit) + len(ids)
            out.append(b"".join([met[u] if u in met else self._unit(u) for u in units]))
            if self.met_bytes > CACHE_BYTES:
                self.earlier, self.met, self.met_bytes = met, {}, 0
        out.append(np.array([self.model.eos_id()], dtype="<u4").tobytes())
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """The text in slices, each from a token with a leading space on."""
        at = 0
        while at < len(ids):
            end = min(at + STRETCH, len(ids))
            ahead = np.flatnonzero(self.spaced[ids[end:]])[:1] if end < len(ids) else ()
            end = end + int(ahead[0]) if len(ahead) else len(ids)
            text = self.model.decode(ids[at:end].tolist())
            yield " " + text if at and self.leading else text
            at = end


@lru_cache(None)
def codec(path: str) -> Codec:
    return Codec(path)


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, size=SLICE):
            rows: list[list] = [[], [], []]
            for text in batch.column("text"):
                ids = own.encode(text.as_py() or "")
                back = hashlib.sha256()
                for part in own.decode(ids):
                    back.update(part.encode())
                for column, x in zip(rows, (len(ids), hashlib.sha256(ids).hexdigest(), back.hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.string(), pa.string()), strict=True))],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, size=SLICE):
            ids = [own.encode(t.as_py() or "").astype(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if ids is None else "".join(own.decode(np.asarray(ids, dtype="<u4"))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every whole text."""
    return text_docs(docs).mapInArrow(_encoded(path or default_path()), "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    return ids.select("doc_id", "ids").mapInArrow(_decoded(path or default_path()), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, without holding ids or texts in rows."""
    return text_docs(docs).mapInArrow(_coded(path or default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
