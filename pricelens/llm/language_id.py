"""Language identification of spans of mixed-language text.

Method. Training counts byte trigrams (with word edges) of the lower-cased words
of each labelled language, hashed to 2**``BITS`` places, and the scripts that its
words use. A word's script, the code point range of its first character, narrows its
candidates to the languages that use that script; each candidate's score is the sum of its
trigrams' log likelihoods. Viterbi over a document's words, with a penalty for each
switch of language, labels the words; runs of equal labels are the spans. The document's
language is the one with the most letters. The score is the share of all letters that give evidence for it:
those of its words whose script it uses and whose likelihood by trigram beats the background, which lies halfway
between what the language's own trigrams have on average and evenly spread places.

The model is bounded by the number of languages and the table size, whatever the
corpus: each training task sends one table per language, added up by language.
Words are runs of letters: a-z after lower-casing and all characters outside ASCII.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no spans;
so is every text if there is nothing to learn from; ties go to the first language by name;
a word that starts with a character of no script (a sign, say) keeps all candidates;
words of a script that no language uses are labelled by their neighbours and give no evidence, so
a text of such words alone has score 0; a very long text is scored in blocks cut between words, with the result of the whole,
and keeps a few numbers for each of its words; an empty table gives no rows and teaches nothing; rows
repeat as they come; a null doc_id is never held out. Only doc_id and text are
read for a prediction, and text and lang of the training rows for learning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held_out, text_docs
from .scan import BLOCK, _classes, _segments, buffers, slices, word_bounds

BITS = 16
#: log10 cost of a change of language between two words; log10 cost of a language that does not use the word's script.
SWITCH, FOREIGN = 6.0, 20.0
#: A language uses a script if it has at least this share of its words.
SCRIPT_SHARE = 0.005
UND = "und"
LETTERS = _classes({*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: The scripts' code point ranges (first, after the last, script). What lies in none is "other".
SCRIPT_RANGES = [
    (0x0041, 0x005B, "Latin"), (0x0061, 0x007B, "Latin"), (0x00AA, 0x00AB, "Latin"), (0x00BA, 0x00BB, "Latin"), (0x00C0, 0x02B0, "Latin"),
    (0x0370, 0x0400, "Greek"), (0x0400, 0x0530, "Cyrillic"), (0x0531, 0x0590, "Armenian"), (0x0590, 0x0600, "Hebrew"), (0x0600, 0x0700, "Arabic"),
    (0x0700, 0x0750, "Syriac"), (0x0750, 0x0780, "Arabic"), (0x0780, 0x07C0, "Thaana"), (0x07C0, 0x0800, "Nko"), (0x0860, 0x0870, "Syriac"), (0x0870, 0x0900, "Arabic"),
    (0x0900, 0x0980, "Devanagari"), (0x0980, 0x0A00, "Bengali"), (0x0A00, 0x0A80, "Gurmukhi"), (0x0A80, 0x0B00, "Gujarati"), (0x0B00, 0x0B80, "Oriya"),
    (0x0B80, 0x0C00, "Tamil"), (0x0C00, 0x0C80, "Telugu"), (0x0C80, 0x0D00, "Kannada"), (0x0D00, 0x0D80, "Malayalam"), (0x0D80, 0x0E00, "Sinhala"),
    (0x0E00, 0x0E80, "Thai"), (0x0E80, 0x0F00, "Lao"), (0x0F00, 0x1000, "Tibetan"), (0x1000, 0x10A0, "Myanmar"), (0x10A0, 0x1100, "Georgian"),
    (0x1100, 0x1200, "Hangul"), (0x1200, 0x13A0, "Ethiopic"), (0x13A0, 0x1400, "Cherokee"), (0x1400, 0x1680, "Canadian syllabics"), (0x1780, 0x1800, "Khmer"),
    (0x1800, 0x18B0, "Mongolian"), (0x1C80, 0x1C90, "Cyrillic"), (0x1C90, 0x1CC0, "Georgian"), (0x1E00, 0x1F00, "Latin"), (0x1F00, 0x2000, "Greek"),
    (0x2C60, 0x2C80, "Latin"), (0x2D00, 0x2D30, "Georgian"), (0x2D30, 0x2D80, "Tifinagh"), (0x2D80, 0x2DE0, "Ethiopic"), (0x2DE0, 0x2E00, "Cyrillic"),
    (0x2E80, 0x2FE0, "Han"), (0x3005, 0x3008, "Han"), (0x3040, 0x30A0, "Kana"), (0x30A0, 0x3100, "Kana"), (0x3100, 0x3130, "Bopomofo"), (0x3130, 0x3190, "Hangul"),
    (0x31A0, 0x31C0, "Bopomofo"), (0x31F0, 0x3200, "Kana"), (0x3400, 0x4DC0, "Han"), (0x4E00, 0xA000, "Han"), (0xA000, 0xA4D0, "Yi"), (0xA640, 0xA6A0, "Cyrillic"),
    (0xA720, 0xA800, "Latin"), (0xA8E0, 0xA900, "Devanagari"), (0xA960, 0xA980, "Hangul"), (0xAB30, 0xAB70, "Latin"), (0xAB70, 0xABC0, "Cherokee"),
    (0xAC00, 0xD800, "Hangul"), (0xF900, 0xFB00, "Han"), (0xFB00, 0xFB07, "Latin"), (0xFB13, 0xFB18, "Armenian"), (0xFB1D, 0xFB50, "Hebrew"),
    (0xFB50, 0xFE00, "Arabic"), (0xFE70, 0xFEFF, "Arabic"), (0xFF21, 0xFF3B, "Latin"), (0xFF41, 0xFF5B, "Latin"), (0xFF66, 0xFFA0, "Kana"), (0xFFA0, 0xFFE0, "Hangul"),
    (0x20000, 0x32000, "Han")]
SCRIPTS = ["other", *dict.fromkeys(name for _, _, name in SCRIPT_RANGES)]
N_SCRIPTS = len(SCRIPTS)
_FIRST = np.array([first for first, _, _ in SCRIPT_RANGES])
_AFTER = np.array([after for _, after, _ in SCRIPT_RANGES])
_NUMBER = np.array([SCRIPTS.index(name) for _, _, name in SCRIPT_RANGES])
#: By lead byte of UTF-8: bits of the lead that count, and the number of bytes that follow.
_LEAD = np.arange(256)
_KEPT = np.select([_LEAD < 0xC0, _LEAD < 0xE0, _LEAD < 0xF0], [_LEAD, _LEAD & 0x1F, _LEAD & 0x0F], _LEAD & 0x07)
_FOLLOW = np.select([_LEAD < 0xC0, _LEAD < 0xE0, _LEAD < 0xF0], [0, 1, 2], 3)
#: Type of a label: any number of languages that a model of this size can hold.
LABEL = np.int32
#: Bytes of text that are judged side by side.
SLICE = 2 * BLOCK


def scripts_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script numbers of the characters that start at the given bytes."""
    lead = data[starts]
    point, follow = _KEPT[lead], _FOLLOW[lead]
    for k in (1, 2, 3):
        more = follow >= k
        point[more] = (point[more] << 6) | (data[np.minimum(starts[more] + k, len(data) - 1)] & 0x3F)
    at = np.searchsorted(_FIRST, point, side="right") - 1
    return np.where((at >= 0) & (point < _AFTER[at]), _NUMBER[at], 0)


def _blocks(texts: pa.Array) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """Features of the lower-cased texts, about ``BLOCK`` bytes at a time, and the text of each stretch; long texts are cut between words."""
    data, offsets = buffers(pc.utf8_lower(texts.fill_null("")))
    bounds, owner = _segments(data, offsets, LETTERS[0])
    k = 0
    while k < len(owner):
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + BLOCK, "right")) - 1)
        yield _features(data[bounds[k]:bounds[last]], bounds[k:last + 1] - bounds[k]), owner[k:last]
        k = last


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram places along the bytes of all stretches; words' starts, ends, scripts; and each stretch's words' bounds.

    A word's trigrams are those that end at its bytes; what stands before the word counts as its edge.
    """
    word, _ = LETTERS
    starts, ends = word_bounds(data, offsets, word)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[starts] = True
    code = np.zeros(len(data) + 1, dtype=np.uint32)
    code[:-1] = np.where(word[data], data, 0)
    value = code.astype(np.uint8)
    second = np.zeros_like(first)
    second[1:] = first[:-1]
    code[1:] |= np.where(first[1:], 0, value[:-1]).astype(np.uint32) << np.uint32(8)
    code[2:] |= np.where(first[2:] | second[2:], 0, value[:-2]).astype(np.uint32) << np.uint32(16)
    code ^= code >> np.uint32(11)
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    places = (code >> np.uint32(32 - BITS)).astype(np.int32)
    return places, starts, ends, scripts_of(data, starts), np.searchsorted(starts, offsets)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}
    for batch in slices(batches, size=SLICE):
        names, code = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
        for (places, starts, ends, scripts, at), owner in _blocks(batch.column("text")):
            inside = np.zeros(len(places) + 1, dtype=np.int64)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            inside = np.cumsum(inside[:-1]) > 0
            lang_of_word = code[np.repeat(owner, np.diff(at))]
            of_byte = np.zeros(len(places), dtype=np.int64)
            of_byte[starts] = 1
            of_byte = np.cumsum(of_byte) - 1
            for k in np.unique(lang_of_word).tolist():
                table = tables.setdefault(names[k], np.zeros((1 << BITS) + N_SCRIPTS, dtype=np.int64))
                mine = inside.copy()
                mine[inside] = lang_of_word[of_byte[inside]] == k
                table[:1 << BITS] += np.bincount(places[mine], minlength=1 << BITS)
                table[1 << BITS:] += np.bincount(scripts[lang_of_word == k], minlength=N_SCRIPTS)
        for name in names:
            tables.setdefault(name, np.zeros((1 << BITS) + N_SCRIPTS, dtype=np.int64))
    yield _tables(tables)


def _tables(tables: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(tables), pa.string()), pa.array([zlib.compress(t.tobytes(), 1) for t in tables.values()], pa.binary())], ["lang", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, counts in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            found = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
            tables[lang] = tables[lang] + found if lang in tables else found
    yield _tables(tables)


class Model:
    """Log likelihoods by trigram place and language, relative to the languages' mean, and which scripts each uses."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams = counts[:, :1 << BITS].astype(np.float64) + 0.5
        log = np.log10(grams / grams.sum(axis=1, keepdims=True))
        self.mean = log.mean(axis=0)
        self.table = np.ascontiguousarray((log - self.mean).T)
        #: Least mean log likelihood of a trigram in a word that is evidence for the language.
        self.background = ((10 ** log * log).sum(axis=1) - BITS * np.log10(2)) / 2
        words = counts[:, 1 << BITS:]
        self.uses = ((words >= SCRIPT_SHARE * words.sum(axis=1, keepdims=True)) & (words > 0)).T
        self.uses[0] = True

    def word_scores(self, places: np.ndarray, starts: np.ndarray, ends: np.ndarray, scripts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every word's score by language, and what the languages' mean gives it."""
        out = np.empty((len(starts), len(self.langs)))
        sums = np.zeros(len(places) + 1)
        for k in range(len(self.langs)):
            np.cumsum(self.table[:, k][places], out=sums[1:])
            out[:, k] = sums[ends] - sums[starts]
        np.cumsum(self.mean[places], out=sums[1:])
        usable = self.uses[scripts]
        return np.where(usable.any(axis=1, keepdims=True), np.where(usable, out, out - FOREIGN), 0.0), sums[ends] - sums[starts]

    def evidence(self, scores: np.ndarray, means: np.ndarray, lengths: np.ndarray, scripts: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Which words are evidence for their label: a language that uses the script, and trigrams likelier than its background."""
        own = scores[np.arange(len(labels)), labels] + means
        return (own > lengths * self.background[labels]) & self.uses[scripts, labels]


def learn(labelled: DataFrame) -> Model | None:
    """The model of (text, lang) rows; nulls teach nothing."""
    rows = (labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
            .mapInArrow(_train, "lang string, counts binary").repartition("lang").mapInArrow(_add_up, "lang string, counts binary"))
    tables = {r["lang"]: np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64) for r in rows.collect()}
    langs = sorted(tables)
    return Model(langs, np.stack([tables[k] for k in langs])) if langs else None


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of every word; texts (bounds ``at``) go side by side, one word a step."""
    labels = np.zeros(len(scores), dtype=LABEL)
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return labels
    begin, rising = at[:-1][order], lengths[order][::-1]
    switched = np.zeros(scores.shape, dtype=bool)
    top = np.zeros(len(scores), dtype=LABEL)
    best = scores[begin].copy()
    last = np.zeros(len(order), dtype=LABEL)
    running = len(order)
    for t in range(1, int(lengths[order[0]])):
        still = len(order) - int(np.searchsorted(rising, t, "right"))
        if still < running:
            last[still:running] = best[still:running].argmax(axis=1)
            running = still
        w = begin[:running] + t
        now = best[:running]
        lead = now.argmax(axis=1)
        changed = now[np.arange(running), lead] - penalty
        moved = now < changed[:, None]
        switched[w], top[w] = moved, lead
        best[:running] = np.where(moved, changed[:, None], now) + scores[w]
    last[:running] = best[:running].argmax(axis=1)
    label = last.copy()
    for t in range(int(lengths[order[0]]) - 1, 0, -1):
        running = len(order) - int(np.searchsorted(rising, t, "right"))
        w = begin[:running] + t
        labels[w] = label[:running]
        back = switched[w, label[:running]]
        label[:running] = np.where(back, top[w], label[:running])
    labels[begin] = label
    return labels


def _word_table(texts: pa.Array, model: Model) -> tuple[np.ndarray, ...]:
    """Of all words in order: scores by language, sum of the languages' mean, length, script, and the text they stand in."""
    parts = [(np.zeros((0, len(model.langs))), np.zeros(0), *[np.zeros(0, dtype=np.int64)] * 3)]
    for (places, starts, ends, scripts, at), owner in _blocks(texts):
        parts.append((*model.word_scores(places, starts, ends, scripts), ends - starts, scripts, np.repeat(owner, np.diff(at))))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def _judged(texts: pa.Array, model: Model | None) -> list[pa.Array]:
    """lang_pred, score and spans of a column of texts."""
    n = len(texts)
    langs: list[str] = [UND] * n
    scores = np.zeros(n)
    spans: list[list[dict]] = [[] for _ in range(n)]
    if model is not None:
        scores_of, means, lengths, scripts, owner = _word_table(texts, model)
        at = np.searchsorted(owner, np.arange(n + 1))
        labels = viterbi(scores_of, at)
        letters = np.bincount(owner * len(model.langs) + labels, weights=lengths, minlength=n * len(model.langs)).reshape(n, -1)
        total = letters.sum(axis=1)
        sure = model.evidence(scores_of, means, lengths, scripts, labels)
        proven = np.bincount((owner * len(model.langs) + labels)[sure], weights=lengths[sure], minlength=n * len(model.langs)).reshape(n, -1)
        plain = _ascii_letters(texts)
        for k in np.flatnonzero(total).tolist():
            if not plain[k] and not any(map(str.isalpha, texts[k].as_py())):
                continue
            best = int(letters[k].argmax())
            langs[k], scores[k] = model.langs[best], proven[k, best] / total[k]
            own = labels[at[k]:at[k + 1]]
            cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)])).tolist()
            spans[k] = [{"first_word": a, "n_words": b - a, "lang": model.langs[own[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [pa.array(langs, pa.string()), pa.array(scores), pa.array(spans, _SPANS)]


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))


def _ascii_letters(texts: pa.Array) -> np.ndarray:
    """Whether each text has an ASCII letter."""
    data, offsets = buffers(texts)
    low = data | 0x20
    sums = np.concatenate(([0], np.cumsum((low >= 0x61) & (low <= 0x7A) & (data < 0x80))))
    return sums[offsets[1:]] > sums[offsets[:-1]]


_SPANS_TYPE = "array<struct<first_word:long,n_words:long,lang:string>>"


def predict(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score", spans: str = "spans") -> DataFrame:
    """``docs`` with three more columns under the given names; all columns pass through, in place."""
    inner = [f"c{k}" for k in range(len(docs.columns))]
    text = docs.columns.index("text")
    schema = ", ".join(f"{c} {t}" for c, (_, t) in zip(inner, docs.dtypes, strict=True)) + f", lang string, score double, spans {_SPANS_TYPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, inner[text], SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, *_judged(batch.column(text), model)], [*inner, "lang", "score", "spans"])

    return docs.toDF(*inner).mapInArrow(run, schema).toDF(*docs.columns, lang, score, spans)


def learn_from(docs: DataFrame) -> Model | None:
    """The model of the labelled rows whose crc32(doc_id) mod 3 is not 1."""
    return learn(docs.where(~held_out(F.col("doc_id"), 3, 1)))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, spans, held_out) of all rows."""
    out = predict(text_docs(docs), learn_from(docs))
    return out.select("doc_id", "lang_pred", "score", "spans", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
