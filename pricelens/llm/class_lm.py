"""Language-model scores by a Brown class-based bigram model.

Method. Every training word belongs to a class; the chance of a word after another is the chance of
its class after the other's class, times the chance of the word within its class. Classes are assigned by exchange, so
that the likelihood of the training bigrams rises, in three steps:

1. The ``HEAD`` most frequent words (one symbol each; one more symbol for all others, one for a text's end) are exchanged one at a
   time on their bigram table until the likelihood has settled.
2. All words of the training texts: each word's counts beside the classes of step 1 are a row of a table; in rounds every word goes to
   the class that makes its counts most likely, then the classes' counts are added up anew, until the likelihood has settled.
3. The same once more, beside the classes of step 2, which all words have.

The number of classes grows with the vocabulary (its cube root, ``LEAST_CLASSES`` at least). What stands before a word has its class
of step 2, however rare it is; only words that no training text has are one class there.

What grows with the corpus stays distributed: the counts of all words, their counts beside each class, and their
classes (one row a word each); the words outside the KNOWN most frequent meet theirs in a join, and so do, as neighbours, those
outside the HELD most frequent. What reaches the driver is bounded by the parameters and the number of classes: the HEAD, KNOWN and
HELD words, the symbols' bigram table and the classes' counts, added up by Spark.

Smoothing: class transitions are interpolated with class frequencies (``KAPPA`` counts); a class keeps one
count for unseen words and each word has one more than its own; an unseen word gets what all classes keep for it.
perplexity is 10 ** (-score / n_tokens).

Defined results: null and empty texts are one end token; with nothing to learn from all counts are 0, the base scores 0 and the scores
those of unseen words; rows repeat as they come; a null doc_id is not held out. Very long texts are scanned in blocks of whole words.
Ties between classes go to the one with the smallest number. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, held_out, release, stored, text_docs
from .scan import SPACED, longs, mix, slices, word_hashes

HEAD, LEAST_CLASSES = 1536, 48
#: Symbols of the head's bigram table: the head words, REST (all other words), END (the end token).
SYMBOLS, REST, END = HEAD + 2, HEAD, HEAD + 1
#: Words whose counts and classes tasks hold, and words whose classes as neighbours they hold; joins bring all others'.
KNOWN = 1 << 18
HELD = KNOWN
KAPPA = 20.0
#: The likelihood has settled when it rises by less than this share (of the bits that classes save, on the bigram table; of itself, in rounds).
SETTLED = 1e-3
#: A word's count beside a class is one long: the count above these bits, the place of the class below.
PLACE_BITS = 20
#: Cells (a word beside a class) compared with all classes at a time.
CELLS = 1 << 14
#: The end token's hash.
END_HASH = np.uint64(0x0E0D0E0D0E0D0E0D)


def class_count(words: int) -> int:
    return max(LEAST_CLASSES, round(words ** (1 / 3)))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with each text's end, and the texts' bounds."""
    words, at = word_hashes(texts, SPACED)
    bounds = at + np.arange(len(at))
    slot = np.ones(len(words) + len(at) - 1, dtype=bool)
    slot[bounds[1:] - 1] = False
    hashes = np.full(len(slot), END_HASH)
    hashes[slot] = words
    return hashes, bounds


class Words:
    """A value for each of some words, another for all others."""

    def __init__(self, words: np.ndarray, values: np.ndarray, other: int):
        order = np.argsort(words)
        self.words, self.values, self.other = words[order], values[order].astype(np.int64), other

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.other, dtype=np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            found = self.words[at] == hashes
            out[found] = self.values[at[found]]
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        word, n = np.unique(tokens(batch.column("text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([longs(word), longs(n)], ["word", "n"])


def _bigrams(symbols: Words):
    """One row per symbol with the counts of what follows it, from each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
        for batch in slices(batches):
            s = symbols(tokens(batch.column("text"))[0])
            before = np.concatenate(([END], s[:-1]))  # each text follows an end
            pair, n = np.unique(before * SYMBOLS + s, return_counts=True)
            table[pair] += n
        table = table.reshape(SYMBOLS, SYMBOLS)
        used = np.flatnonzero(table.any(axis=1))
        yield _rows(used, [table[k] for k in used])
    return run


def _rows(symbols: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([longs(symbols), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], ["symbol", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for symbol, counts in zip(batch.column("symbol").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            row = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
            total[symbol] = total[symbol] + row if symbol in total else row
    yield _rows(np.array(list(total), dtype=np.int64), list(total.values()))


def exchange(table: np.ndarray, classes: int, rest: bool = False, settled: float = 0.0) -> np.ndarray:
    """Class of each symbol. Symbols start dealt by frequency; each in turn is taken out and put where the likelihood
    sum n(c, d) log n(c, d) - sum n(c) log n(c) - sum n(d) log n(d) is greatest, until no symbol moves or all moves of a pass raise it by less than
    the share ``settled``. The last symbol, the end token, keeps class 0; with ``rest`` the one before it keeps a class of its own, number ``classes``."""
    def plogp(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    table = table.astype(np.float64)
    n = table.shape[0]
    weight = table.sum(axis=0) + table.sum(axis=1)
    by_weight = np.argsort(-weight, kind="stable")
    by_weight = by_weight[by_weight < n - 1 - rest]
    klass = np.zeros(n, dtype=np.int64)
    klass[by_weight] = 1 + np.arange(n - 1 - rest) % (classes - 1)
    if rest:
        klass[n - 2] = classes
    one_hot = np.zeros((n, classes + rest))
    one_hot[np.arange(n), klass] = 1
    to, come = table @ one_hot, table.T @ one_hot  # symbol -> class counts after it and before it
    joint = one_hot.T @ to
    entropy = plogp(joint)
    worth = lambda: entropy.sum() - plogp(joint.sum(axis=0)).sum() - plogp(joint.sum(axis=1)).sum() + plogp(joint.sum())
    moved, last = 1, worth()
    while moved:
        moved = 0
        for w in by_weight.tolist():
            if not weight[w]:
                continue
            old, own = klass[w], table[w, w]
            right, left = to[w].copy(), come[w].copy()
            right[old] -= own
            left[old] -= own
            joint[old] -= right
            joint[:, old] -= left
            joint[old, old] -= own
            row, column = joint.sum(axis=1) + left, joint.sum(axis=0) + right  # wherever the symbol goes, the others' counts with it stay
            entropy[old], entropy[:, old] = plogp(joint[old]), plogp(joint[:, old])
            out, into = right.sum() + own, left.sum() + own
            # Gain of each class: its row and column with this symbol's counts, its corner with both and the symbol after itself.
            beside, above = np.flatnonzero(right), np.flatnonzero(left)
            gain = (plogp(joint[:, beside] + right[beside]) - entropy[:, beside]).sum(axis=1) + (plogp(joint[above] + left[above, None]) - entropy[above]).sum(axis=0)
            corner = np.diag(joint)
            gain += plogp(corner + right + left + own) - plogp(corner + right) - plogp(corner + left) + plogp(corner)
            gain -= plogp(row + out) - plogp(row) + plogp(column + into) - plogp(column)
            gain[0] = -np.inf
            gain[classes:] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            joint[new] += right
            joint[:, new] += left
            joint[new, new] += own
            entropy[new], entropy[:, new] = plogp(joint[new]), plogp(joint[:, new])
            if new != old:
                moved += 1
                klass[w] = new
                to[:, old] -= table[:, w]
                to[:, new] += table[:, w]
                come[:, old] -= table[w]
                come[:, new] += table[w]
        now = worth()
        if now - last <= settled * abs(now):
            break
        last = now
    return klass


def _contexts(history: Words, classes: int):
    """(word, cells): counts of each word beside the classes of its neighbours, place h after class h, place classes + 1 + h before class h.
    What follows an end is none of its neighbours. Neighbours whose class is not held are left to ``_others``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = 2 * (classes + 1)
        for batch in slices(batches):
            hashes, _ = tokens(batch.column("text"))
            h = _neighbours(history, hashes)
            word, at = np.unique(hashes, return_inverse=True)
            inner = np.flatnonzero(hashes != END_HASH)
            before, after = np.concatenate(([0], h[:-1])), h[inner + 1]
            cell, n = np.unique(np.concatenate(((at * places + before)[before >= 0], (at[inner] * places + classes + 1 + after)[after >= 0])), return_counts=True)
            yield _packed(word[cell // places], cell % places, n)
    return run


def _neighbours(history: Words, hashes: np.ndarray) -> np.ndarray:
    h = history(hashes)
    h[hashes == END_HASH] = 0
    return h


def _others(history: Words):
    """Counts of each word beside each neighbour whose class is not held; side 0: after it, side 1: before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, _ = tokens(batch.column("text"))
            at = np.flatnonzero(_neighbours(history, hashes) < 0)
            inner = at[at > 0]
            inner = inner[hashes[inner - 1] != END_HASH]
            other, word = np.concatenate((hashes[at], hashes[inner])), np.concatenate((hashes[at + 1], hashes[inner - 1]))
            side = np.repeat([0, 1], (len(at), len(inner)))
            order = np.lexsort((side, word, other))
            other, word, side = other[order], word[order], side[order]
            first = np.flatnonzero(np.concatenate(([True], (other[1:] != other[:-1]) | (word[1:] != word[:-1]) | (side[1:] != side[:-1])))[:len(order)])
            yield pa.RecordBatch.from_arrays([longs(other[first]), longs(word[first]), longs(side[first]), longs(np.diff(np.append(first, len(order))))], ["other", "word", "side", "n"])
    return run


_CELLS = "word long, cells array<long>"


def _packed(word: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each run of equal words, with its cells."""
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))[:len(word)])
    cells = pa.ListArray.from_arrays(pa.array(np.append(first, len(word)), pa.int32()), longs(n << PLACE_BITS | place))
    return pa.RecordBatch.from_arrays([longs(word[first]), cells], ["word", "cells"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a word, its counts added up; the rows of a word come one after the other. The last word of a batch waits for the next."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        words, at, place, n = _unpacked(batch)
        word = np.repeat(words, np.diff(at))
        if rest is not None:
            word, place, n = (np.concatenate(x) for x in zip(rest, (word, place, n), strict=True))
        key = np.cumsum(np.concatenate(([0], word[1:] != word[:-1]))) << PLACE_BITS | place
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        word, place, n = word[order][first], place[order][first], np.add.reduceat(n[order], first)
        last = int(np.searchsorted(key[first], key[-1] >> PLACE_BITS << PLACE_BITS))
        rest = word[last:], place[last:], n[last:]
        if last:
            yield _packed(word[:last], place[:last], n[:last])
    if rest is not None:
        yield _packed(*rest)


def _beside(texts: DataFrame, history: Words, classes: int, name: str, everyone: DataFrame | None = None) -> DataFrame:
    """(word, cells): a row per word with its counts beside each class; ``everyone`` has the classes (word, class) of neighbours that ``history`` does not hold."""
    rows = texts.mapInArrow(_contexts(history, classes), _CELLS)
    if everyone is not None:
        found = texts.mapInArrow(_others(history), "other long, word long, side long, n long").join(everyone.select(F.col("word").alias("other"), "class"), "other")
        place = F.col("class") + F.col("side") * (classes + 1)
        rows = rows.unionByName(found.select("word", F.array(F.shiftleft("n", PLACE_BITS).bitwiseOR(place)).alias("cells")))
    vectors = stored(rows.repartition("word").sortWithinPartitions("word").mapInArrow(_merged, _CELLS), name)
    release(texts.sparkSession)
    return vectors


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the bounds of their cells, and the cells' places and counts."""
    cells = batch.column("cells")
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(cells).to_numpy(zero_copy_only=False)))).astype(np.int64)
    values = cells.flatten().to_numpy(zero_copy_only=False)
    return batch.column("word").to_numpy().view(np.uint64), at, values & ((1 << PLACE_BITS) - 1), values >> PLACE_BITS


def logs_of(profile: np.ndarray) -> np.ndarray:
    """Log chances of the places (before, after) within each class from the counts (places, classes); each class has one more count on each side, spread as all words' are."""
    out = np.empty(profile.shape)
    for side in (slice(0, len(profile) // 2), slice(len(profile) // 2, None)):
        seen = profile[side]
        share = (seen.sum(axis=1, keepdims=True) + 1) / (seen.sum() + len(seen))
        out[side] = np.log((seen + share) / (seen.sum(axis=0) + 1))
    out[:, 0] = -np.inf  # the end token's
    return out


def best_classes(logs: np.ndarray, words: np.ndarray, at: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class that makes each word's counts most likely, and that log likelihood. The end token has class 0."""
    klass, gain = np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
    k = 0
    while k < len(words):
        last = max(k + 1, int(np.searchsorted(at, at[k] + CELLS, "right")) - 1)
        part = slice(at[k], at[last])
        likely = np.add.reduceat(logs[place[part]] * n[part, None], at[k:last] - at[k], axis=0)
        klass[k:last] = likely.argmax(axis=1)
        gain[k:last] = likely.max(axis=1)
        k = last
    end = words == END_HASH
    klass[end], gain[end] = 0, 0.0
    return klass, gain


def _refit(classes: int, logs: np.ndarray | None, given: Words | None):
    """The classes' counts after every word went to its best class (or, with ``given``, to the class given): cells of place * classes + class, then the classes' words, then the likelihood."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = 2 * (classes + 1)
        total = np.zeros((places + 1) * classes + 1)
        for batch in batches:
            words, at, place, n = _unpacked(batch)
            if given is None:
                klass, gain = best_classes(logs, words, at, place, n)
                total[-1] += gain.sum()
            else:
                klass = given(words)
            of = np.repeat(klass, np.diff(at))
            total[:places * classes] += np.bincount((place * classes + of)[of >= 0], weights=n[of >= 0], minlength=places * classes)
            total[places * classes:-1] += np.bincount(klass[klass >= 0], minlength=classes)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([longs(used), pa.array(total[used])], ["cell", "n"])
    return run


def _refitted(vectors: DataFrame, classes: int, logs: np.ndarray | None, given: Words | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    places = 2 * (classes + 1)
    sums = vectors.mapInArrow(_refit(classes, logs, given), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((places + 1) * classes + 1)
    total[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return total[:places * classes].reshape(places, classes), total[places * classes:-1], float(total[-1])


def settle(vectors: DataFrame, profile: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounds from the counts ``profile``: (logs, counts, words of each class), the last two by the classes that the first gives."""
    last = -np.inf
    while True:
        logs = logs_of(profile)
        profile, sizes, likelihood = _refitted(vectors, profile.shape[1], logs)
        if likelihood - last <= SETTLED * abs(likelihood):
            return logs, profile, sizes
        last = likelihood


def _classes(logs: np.ndarray):
    """(word, n, class) of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at, place, n = _unpacked(batch)
            total = np.add.reduceat(np.where(place < len(logs) // 2, n, 0), at[:-1]) if len(words) else n
            yield pa.RecordBatch.from_arrays([longs(words), longs(total), longs(best_classes(logs, words, at, place, n)[0])], ["word", "n", "class"])
    return run


class Model:
    """log10 tables of the class model, counts and classes of the KNOWN most frequent words, classes of the HELD most frequent as neighbours, and totals.

    ``outside``: other words have a class as neighbours too, column ``before`` of the lexicon; ``history`` gives -1 for them.
    """

    def __init__(self, history: Words, profile: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, klass: np.ndarray, n: int, v: int, outside: bool):
        self.history, self.n, self.v, self.outside = history, n, v, outside
        #: Words of no training text, as what stands before.
        self.unmet = profile.shape[1]
        joint = profile[:len(profile) // 2]
        class_tokens = joint.sum(axis=0)
        share = (class_tokens + 1.0) / (class_tokens + 1.0).sum()
        self.transition = np.log10((joint + KAPPA * share) / (joint.sum(axis=1, keepdims=True) + KAPPA))
        self.room = np.log10(class_tokens + sizes + 1.0)
        #: An unseen word's, after each class: what all classes keep for it.
        self.unseen = np.log10((10 ** (self.transition - self.room)).sum(axis=1))
        self.known, self.klass = Words(words, counts, 0), Words(words, klass, -1)


def learn(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all texts of ``training``, and (word, n, class[, before]) of all their words."""
    texts = training.select("text")
    counts = cut(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    classes = class_count(v)
    # The most frequent words, to whole steps of frequency: their number is found first, so only they travel.
    step = F.floor(F.log2("n") * 8)
    steps = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)

    def most_frequent(most: int) -> tuple[Column, int]:
        least, taken = F.lit(False), 0
        for at, size in steps:
            if taken + size > most:
                break
            least, taken = step >= at, taken + size
        return least, taken
    (often, _), (held, holds) = most_frequent(KNOWN), most_frequent(HELD)
    outside = holds < v
    frequent = counts.where(often).toArrow()
    words, times = frequent["word"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    words = words[np.lexsort((words.view(np.int64), -times))]
    head = words[words != END_HASH][:HEAD]
    symbols = Words(np.append(head, END_HASH), np.append(np.arange(len(head)), END), REST)
    table = np.zeros((SYMBOLS, SYMBOLS), dtype=np.int64)
    for row in (texts.mapInArrow(_bigrams(symbols), "symbol long, counts binary").repartition("symbol").mapInArrow(_add_up, "symbol long, counts binary").collect()):
        table[row["symbol"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    klass = exchange(table, classes, rest=True, settled=SETTLED)
    one_hot = np.zeros((SYMBOLS, classes + 1))
    one_hot[np.arange(SYMBOLS), klass] = 1
    joint = one_hot.T @ table @ one_hot
    profile = np.concatenate((joint[:, :classes], joint[:classes].T))
    history = Words(np.append(head, END_HASH), np.append(klass[:len(head)], 0), classes)
    vectors = _beside(texts, history, classes, "class-lm-first")
    logs, _, _ = settle(vectors, profile)
    first = vectors.mapInArrow(_classes(logs), "word long, n long, class long")
    if outside:
        first = stored(first, "class-lm-neighbours")
    found = first.where(held).toArrow()
    history = Words(found["word"].to_numpy().view(np.uint64), found["class"].to_numpy(), -1 if outside else classes)
    given = Words(history.words, history.values, -1)
    vectors = _beside(texts, history, classes, "class-lm-words", first if outside else None)
    logs, profile, sizes = settle(vectors, _refitted(vectors, classes, None, given)[0])
    lexicon = vectors.mapInArrow(_classes(logs), "word long, n long, class long")
    if outside:
        lexicon = lexicon.join(first.select("word", F.col("class").alias("before")), "word")
    lexicon = stored(lexicon, "class-lm-lexicon")
    found = lexicon.where(often).toArrow()
    return Model(history, profile, sizes, found["word"].to_numpy().view(np.uint64), found["n"].to_numpy(), found["class"].to_numpy(), n, v, outside), lexicon


_PARTS = "row long, doc_id long, previous long, word long, before long, own_n long, own_class long, times long, n_tokens long, n_known long, base double, model double"
_SUMS = "row long, doc_id long, n_tokens long, n_known long, base double, model double"


def _score(model: Model):
    """A row per text with what the model itself holds, and a row per text, word and what stands before it, where the word (own_class -1) or
    the class before it (before -1) is to be looked up. Keys that nothing is looked up by are dealt by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.log10(model.n + model.v + 1.0)
        for batch in slices(batches):
            hashes, at = tokens(batch.column("text"))
            n = batch.num_rows
            c, k = model.known(hashes), model.klass(hashes)
            before = np.concatenate(([0], _neighbours(model.history, hashes)[:-1]))
            before[at[:-1]] = 0  # a text follows an end
            previous = np.where(before < 0, np.concatenate(([END_HASH], hashes[:-1])), np.uint64(0))
            own = np.log10(c + 1.0)
            owner = np.repeat(np.arange(n), np.diff(at))
            here = (k >= 0) & (before >= 0)
            base = np.bincount(owner, weights=own - scale, minlength=n)
            score = np.bincount(owner, weights=np.where(here, own + model.transition[before, k] - model.room[k], 0.0), minlength=n)
            known = np.bincount(owner, weights=c > 0, minlength=n).astype(np.int64)
            row = batch.column("row").to_numpy()
            left = np.flatnonzero(~here)
            order = left[np.lexsort((before[left], previous[left], hashes[left], owner[left]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (hashes, owner, before, previous)], axis=0)
            first = np.flatnonzero(new)
            times = np.diff(np.concatenate((first, [len(order)])))
            picked = order[first]
            m = len(picked)
            dealt = mix(row.astype(np.uint64))
            none, zero, nought = longs(np.zeros(n, dtype=np.int64)), longs(np.zeros(m, dtype=np.int64)), pa.array(np.zeros(m))
            whole = [longs(row), batch.column("doc_id"), longs(dealt), longs(dealt), none, none, longs(np.full(n, -1)), none, longs(np.diff(at)), longs(known), pa.array(base), pa.array(score)]
            part = [longs(row[owner[picked]]), pa.nulls(m, pa.int64()), longs(np.where(before[picked] < 0, previous[picked], dealt[owner[picked]])),
                    longs(np.where(k[picked] < 0, hashes[picked], dealt[owner[picked]])), longs(before[picked]), longs(c[picked]), longs(k[picked]), longs(times), zero, zero, nought, nought]
            names = [x.split()[0] for x in _PARTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(whole, part, strict=True)], names)
    return run


def _look_up(model: Model):
    """What the parts add, by their word's count and class (null: unseen); a word that the model holds is counted already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = (batch.column(x).fill_null(-1).to_numpy(zero_copy_only=False) for x in ("n", "class"))
            before, own_n, own_class, times, known = (batch.column(x).to_numpy() for x in ("before", "own_n", "own_class", "times", "n_known"))
            n, k = np.where(own_class < 0, n, own_n), np.where(own_class < 0, k, own_class)
            counted = np.where(own_class < 0, times, 0)
            own = np.log10(np.maximum(n, 0) + 1.0)
            score = np.where(k >= 0, own + model.transition[before, k] - model.room[k], model.unseen[before])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_tokens"), longs(known + np.where(k >= 0, counted, 0)),
                                              pa.array(batch.column("base").to_numpy() + counted * own), pa.array(batch.column("model").to_numpy() + times * score)],
                                             [x.split()[0] for x in _SUMS.split(", ")])
    return run


def score(docs: DataFrame, model: Model, lexicon: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) for every row of ``docs``."""
    parts = text_docs(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(model), _PARTS)
    if model.outside:
        met = lexicon.select(F.col("word").alias("previous"), F.col("before").alias("met"))
        before = F.when(F.col("before") >= 0, F.col("before")).otherwise(F.coalesce("met", F.lit(model.unmet)))
        parts = parts.join(met, "previous", "left").withColumn("before", before).drop("met")
    return (parts.drop("previous").join(lexicon.select("word", "n", "class"), "word", "left").mapInArrow(_look_up(model), _SUMS).groupBy("row")
            .agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score"))
            .select("doc_id", "n_tokens", "n_known", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")))


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 7 is not 2 and score all rows."""
    model, lexicon = learn(docs.where(~held_out(F.col("doc_id"), 7, 2)))
    return (score(docs, model, lexicon).withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
            .withColumn("train_tokens", F.lit(model.n).cast("long")))
