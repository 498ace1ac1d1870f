"""Language-model scores by Brown class-based bigrams.

Exchange clustering assigns words to classes so that class bigrams predict best; a token's probability is that of its
class after the class before it, times that of the word in its class, both smoothed. The ``CLUSTERED`` most frequent
words and groups of like endings of all others are exchanged until none moves. Then each further training word leaves
its endings' group for the class that its own predecessors and successors favour most (one exchange step for each word,
all against the same table). Only words that no training text has get the class of their ending.

Texts are split into words twice: to count the words, and to write each text as a sequence of numbers (``_sequences``) from
which bigrams, neighbours and scores are counted. All counts cover all training texts and are summed in Spark.
The counts of the ``HEAD`` most frequent words (a fixed bound) are broadcast; those of all other words, whose number
grows with the corpus, are met with their classes by a join on the word's hash. Such words are rare by construction,
so no key is hot. Class transitions are counted after that join, from the classes of all tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.arrow import as_bytes, fold, pieces, ragged, row_hash
from evidentia.plans.scratch import written

HEAD = (1 << 16) - 1  # with one number more for all other words, a word's number has 16 bits
CLUSTERED = 1024
SHAPES = 256
CLASSES = 48
#: Item 0 is the end of a text (and what stands before its start), then come the clustered words, then the shapes.
ITEMS = 1 + CLUSTERED + SHAPES
WORD_PRIOR = 0.5
CLASS_PRIOR = 0.5


def shape_of(word: bytes) -> int:
    """The group of a word's last three bytes."""
    return xxhash.xxh3_64_intdigest(word[-3:], 5) % SHAPES


class _Slots(dict):
    """word -> a dense number, with the word's hash and shape in arrays; reset when full."""

    LIMIT = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []
        self.shapes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        self.shapes.append(shape_of(word))
        return slot

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all words of the texts, and the number of words of each."""
        found = [t.lower().split() if t else [] for t in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        out = np.empty(int(sizes.sum()), np.int64)
        at = 0
        for x in found:
            out[at : at + len(x)] = np.fromiter(map(self.__getitem__, x), np.int64, len(x))
            at += len(x)
        return out, sizes

    @property
    def full(self) -> bool:
        return len(self) > self.LIMIT

    def reset(self) -> None:
        self.clear()
        self.hashes, self.shapes = [], []


def _signed(h: list[int] | np.ndarray) -> np.ndarray:
    return np.array(h, np.uint64).view(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots, total = _Slots(), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_signed(slots.hashes)), pa.array(np.array(slots.shapes, np.int32)), pa.array(total)], ["word", "shape", "n"])

    for part in pieces(batches):
        found, _ = slots.of(as_bytes(part.column("text")))
        counts = np.bincount(found, minlength=len(slots.hashes))
        counts[: len(total)] += total
        total = counts
        if slots.full:
            yield out()
            slots.reset()
            total = np.zeros(0, np.int64)
    yield out()


class Head:
    """The most frequent words: sorted hashes with counts; the first CLUSTERED by count are items of their own."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, shapes: np.ndarray | None = None) -> None:
        """words, counts and shapes come by falling count. ``items``: a word's own item, 0 if it has none; ``places``: that, or its shape's."""
        items = np.zeros(len(words), np.int32)
        items[:CLUSTERED] = np.arange(1, min(CLUSTERED, len(words)) + 1)
        order = np.argsort(words)
        self.words, self.counts, self.items = words[order], counts[order], items[order]
        if shapes is not None:
            self.places = np.where(self.items > 0, self.items, 1 + CLUSTERED + shapes[order])

    def look_up(self, slots: _Slots, known: np.ndarray) -> np.ndarray:
        """For each slot the head's index or -1, extending what is known."""
        new = _signed(slots.hashes[len(known) :])
        if not len(self.words):
            return np.concatenate([known, np.full(len(new), -1)])
        at = np.minimum(np.searchsorted(self.words, new), len(self.words) - 1)
        return np.concatenate([known, np.where(self.words[at] == new, at, -1)])

    def item_of(self, slots: _Slots, index: np.ndarray) -> np.ndarray:
        """For each slot its item: the word's own, else its shape's."""
        shape = 1 + CLUSTERED + np.array(slots.shapes, np.int64)
        own = np.where(index >= 0, self.items[index] if len(self.items) else 0, 0)
        return np.where(own > 0, own, shape)


def _with_ends(items: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items with the end after each text, each token's predecessor, and where the texts start."""
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    full = np.zeros(len(items) + len(sizes), np.int64)
    mask = np.ones(len(full), bool)
    mask[starts + sizes] = False
    full[mask] = items
    before = np.zeros_like(full)
    before[1:] = full[:-1]
    before[starts] = 0
    return full, before, starts


#: The number of all words beyond the head.
OTHER = (1 << 16) - 1


def _sequences(head):
    """Each document as its words' numbers in the head, 16 bits each (OTHER beyond it), with its distinct other words (hash, shape) and those tokens' places in that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: Head = head.value
        slots, known = _Slots(), np.zeros(0, np.int64)
        log_counts = np.log10(h.counts + WORD_PRIOR)
        for part in pieces(batches):
            found, sizes = slots.of(as_bytes(part.column("text")))
            known = h.look_up(slots, known)
            index = known[found]
            in_head = index >= 0
            codes = np.where(in_head, index, OTHER).astype("<u2").tobytes()
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            log_sum = np.bincount(doc, np.where(in_head, log_counts[index] if len(log_counts) else 0.0, 0.0), len(sizes))
            rest = np.flatnonzero(~in_head)
            width = max(1, len(slots.hashes))
            # distinct other words of each document, and for each such token its word
            pair, place = np.unique(doc[rest] * width + found[rest], return_inverse=True)
            owner, slot = np.divmod(pair, width)
            rare = np.bincount(owner, minlength=len(sizes))
            first = np.concatenate([[0], np.cumsum(rare)[:-1]]).astype(np.int64)
            shapes, stops = np.array(slots.shapes, np.uint8)[slot].tobytes() if len(slot) else b"", np.cumsum(rare)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("row"), part.column("held_out"),
                    pa.array(np.bincount(doc, in_head, len(sizes)).astype(np.int64)), pa.array(log_sum),
                    pa.array([codes[2 * (e - n) : 2 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
                    ragged(_signed(slots.hashes)[slot] if len(slot) else np.zeros(0, np.int64), rare),
                    pa.array([shapes[e - n : e] for e, n in zip(stops.tolist(), rare.tolist(), strict=True)], pa.binary()),
                    ragged((place - first[doc[rest]]).astype(np.int32), np.bincount(doc[rest], minlength=len(sizes))),
                ],
                ["doc_id", "row", "held_out", "n_known", "log_sum", "codes", "rare", "shapes", "places"],
            )
            if slots.full:
                slots.reset()
                known = np.zeros(0, np.int64)

    return run


SEQUENCES = "doc_id long, row long, held_out boolean, n_known long, log_sum double, codes binary, rare array<long>, shapes binary, places array<int>"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and each list's number of them."""
    return column.flatten().to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64)


class _Tokens:
    """The documents of a batch of sequences laid end to end."""

    def __init__(self, part: pa.RecordBatch) -> None:
        codes = part.column("codes").to_pylist()
        self.sizes = np.array([len(x) // 2 for x in codes], np.int64)
        self.codes = np.frombuffer(b"".join(codes), "<u2").astype(np.int64)
        self.rare, rares = _lists(part.column("rare"))
        places, each = _lists(part.column("places"))
        self.other = np.flatnonzero(self.codes == OTHER)
        #: for each token beyond the head, its word's place in ``rare``
        self.of_other = places + np.repeat(np.concatenate([[0], np.cumsum(rares)[:-1]]).astype(np.int64), each)
        self.shapes = np.frombuffer(b"".join(part.column("shapes").to_pylist()), np.uint8).astype(np.int64)

    def values(self, of_head: np.ndarray, of_rare: np.ndarray) -> np.ndarray:
        """A value for each token: by its number in the head, or by its place among the other words."""
        out = of_head[np.minimum(self.codes, len(of_head) - 1)] if len(of_head) else np.zeros(len(self.codes), of_rare.dtype)
        out[self.other] = of_rare[self.of_other]
        return out

    def items(self, head: Head) -> np.ndarray:
        return self.values(head.places, 1 + CLUSTERED + self.shapes)


def _bigrams(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ITEMS * ITEMS, np.int64)
        for part in pieces(batches, "codes"):
            tokens = _Tokens(part)
            full, before, _ = _with_ends(tokens.items(head.value), tokens.sizes)
            total += np.bincount(before * ITEMS + full, minlength=ITEMS * ITEMS)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(total[keys])], ["key", "n"])

    return run


def _xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """A class for each item by the exchange algorithm: items move, in order of frequency, to the class that gives the bigrams the highest likelihood, until none moves.

    ``counts`` is the items' bigram matrix (predecessor, item), whose size is fixed. Item 0 keeps class 0 to itself.
    """
    n = len(counts)
    out, into = counts.sum(1), counts.sum(0)
    order = np.argsort(-(out + into), kind="stable")
    order = order[order != 0]
    group = np.zeros(n, np.int64)
    group[order] = 1 + np.arange(len(order)) % (classes - 1)
    one = np.zeros((n, classes))
    one[np.arange(n), group] = 1
    left = counts @ one  # item -> class of its successor
    right = counts.T @ one  # item -> class of its predecessor
    table = one.T @ left

    # a move must gain more than rounding does, so each one raises the likelihood and the sweeps end
    least = 1e-9 + 1e-12 * float(_xlog(counts.sum()))
    moved = 1
    while moved:
        moved = 0
        for w in order:
            if not out[w] + into[w]:
                continue
            c, self_count = group[w], counts[w, w]
            succ, pred = left[w].copy(), right[w].copy()
            succ[c] -= self_count
            pred[c] -= self_count
            # the table without w
            table[c] -= succ
            table[:, c] -= pred
            table[c, c] -= self_count
            # likelihood gained by adding w to each class k (class 0 is the end's own)
            rows, cols = table.sum(1) + pred, table.sum(0) + succ
            gain = (_xlog(table + succ) - _xlog(table)).sum(1) + (_xlog(table + pred[:, None]) - _xlog(table)).sum(0)
            d = np.arange(classes)
            both = table[d, d]
            gain += _xlog(both + succ + pred + self_count) - _xlog(both + succ) - _xlog(both + pred) + _xlog(both)
            gain -= _xlog(rows + out[w]) - _xlog(rows) + _xlog(cols + into[w]) - _xlog(cols)
            gain[0] = -np.inf
            k = int(gain.argmax())
            if gain[k] <= gain[c] + least:
                k = c
            table[k] += succ
            table[:, k] += pred
            table[k, k] += self_count
            if k != c:
                group[w] = k
                moved += 1
                left[:, c] -= counts[:, w]
                left[:, k] += counts[:, w]
                right[:, c] -= counts[w]
                right[:, k] += counts[w]
    return group


#: Keys of a word's neighbours: classes before it, classes after it, itself.
KEYS = 2 * CLASSES + 1
#: Neighbours are packed as count * 128 + key in 32 bits; a count beyond this takes several.
MOST = (1 << 24) - 1


def _packed(keys: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """The packed neighbours of each of n words; ``owner`` (the word's number) rises."""
    times = -(-counts // MOST)
    last = np.cumsum(times) - 1
    out = np.repeat(np.full(len(keys), MOST), times)
    out[last] = counts - (times - 1) * MOST
    flat = (out * 128 + np.repeat(keys, times)).astype("<u4").tobytes()
    sizes = 4 * np.bincount(owner, times, n).astype(np.int64)
    return [flat[end - size : end] for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]


def _contexts(shared):
    """Of each word that is no item of its own: its hash, its ending's class, and its neighbours' classes.

    The head's words are counted over the whole partition, all others by piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, group = shared.value
        size = len(h.words)
        total = np.zeros(size * KEYS, np.int64)

        def out(words: np.ndarray, home: np.ndarray, owner: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(home.astype(np.int8)), pa.array(_packed(key, n, owner, len(words)), pa.binary())], ["word", "home", "near"])

        for part in pieces(batches, "codes"):
            tokens = _Tokens(part)
            item, before, _ = _with_ends(tokens.items(h), tokens.sizes)
            # words by number: the head's first, then the piece's other words by hash
            rare, number = np.unique(tokens.rare, return_inverse=True)
            word, word_before, _ = _with_ends(tokens.values(np.arange(size), size + number) + 1, tokens.sizes)
            at = np.flatnonzero(item > CLUSTERED)
            base, following = (word[at] - 1) * KEYS, np.minimum(at + 1, len(word) - 1)
            again, repeated = word_before[at] == word[at], word[following] == word[at]
            new = np.concatenate([base + np.where(again, 2 * CLASSES, group[before[at]]), (base + CLASSES + group[item[following]])[~repeated]])
            inside = new < size * KEYS
            total += np.bincount(new[inside], minlength=size * KEYS)
            keys, n = np.unique(new[~inside] - size * KEYS, return_counts=True)
            owner, key = np.divmod(keys, KEYS)
            shape = np.zeros(len(rare), np.int64)
            shape[number] = tokens.shapes
            yield out(rare, group[1 + CLUSTERED + shape], owner, key, n)
        mine = np.flatnonzero(total.reshape(size, KEYS).any(1))
        owner, key = np.nonzero(total.reshape(size, KEYS)[mine])
        yield out(h.words[mine], group[h.places[mine]], owner, key, total.reshape(size, KEYS)[mine[owner], key])

    return run


def best_classes(table: np.ndarray, home: np.ndarray, owner: np.ndarray, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The class of most exchange gain for each word, by itself taken out of the class ``home`` that ``table`` counts it in.

    owner (a word's number, rising), key and count: the words' neighbours, each key of a word once.
    """
    n, k = len(home), len(table)
    dense = np.zeros((n, 2 * k + 1))
    dense[owner, key] = count
    pred, succ, self_count = dense[:, :k], dense[:, k : 2 * k], dense[:, 2 * k]
    gain = np.zeros((n, k))
    at_home = np.arange(k) == home[:, None]
    for side, other, t, own in ((succ, pred, table, key // k == 1), (pred, succ, table.T, key // k == 0)):
        w, j, c = owner[own], key[own] % k, count[own][:, None]
        # entries (class, j) of the table without the word
        cell = t[:, j].T - at_home[w] * (c + (j == home[w])[:, None] * self_count[w, None]) - (j == home[w])[:, None] * other[w]
        np.add.at(gain, w, _xlog(cell + c) - _xlog(cell))
        total, mass = t.sum(1) - at_home * (side.sum(1) + self_count)[:, None], (side.sum(1) + self_count)[:, None]
        gain -= _xlog(total + mass) - _xlog(total)
    w = np.flatnonzero(((pred > 0) & (succ > 0)).any(1) | (self_count > 0))
    both = np.diag(table) - at_home[w] * (succ[w] + pred[w] + self_count[w, None])
    gain[w] += _xlog(both + succ[w] + pred[w] + self_count[w, None]) - _xlog(both + succ[w]) - _xlog(both + pred[w]) + _xlog(both)
    gain[:, 0] = -np.inf
    best, here = gain.argmax(1), np.arange(n)
    return np.where(gain[here, best] > gain[here, home] + 1e-6, best, home)


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted rows of words -> (words, homes, owner, key, count) of up to 2048 whole words at a time, each key of a word once."""
    empty = np.zeros(0, np.int64)
    held = (empty, empty, empty, empty, empty)

    def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        word, home, near = batch.column("word").to_numpy(), batch.column("home").to_numpy().astype(np.int64), batch.column("near").to_pylist()
        flat = np.frombuffer(b"".join(near), "<u4").astype(np.int64)
        of = np.repeat(np.arange(len(word)), [len(x) // 4 for x in near]) + len(held[0])
        word, home = np.concatenate([held[0], word]), np.concatenate([held[1], home])
        owner, key, count = np.concatenate([held[2], of]), np.concatenate([held[3], flat % 128]), np.concatenate([held[4], flat // 128])
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        number = np.cumsum(np.concatenate([[0], (word[1:] != word[:-1]).astype(np.int64)]))
        pair, place = np.unique(number[owner] * 128 + key, return_inverse=True)
        count = np.bincount(place, count, len(pair)).astype(np.int64)
        owner, key = np.divmod(pair, 128)
        return word[first], home[first], owner, key, count

    def cut(rows: tuple[np.ndarray, ...], a: int, b: int) -> tuple[np.ndarray, ...]:
        lo, hi = np.searchsorted(rows[2], [a, b])
        return rows[0][a:b], rows[1][a:b], rows[2][lo:hi] - a, rows[3][lo:hi], rows[4][lo:hi]

    for batch in batches:
        if batch.num_rows:
            rows = joined(batch)
            n = len(rows[0])
            for at in range(0, n - 1, 2048):
                yield cut(rows, at, min(at + 2048, n - 1))
            held = cut(rows, n - 1, n)  # its rows may go on
    if len(held[0]):
        yield held


def _classes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for word, home, owner, key, count in _by_word(batches):
            size = len(word)
            tokens = np.bincount(owner, np.where((key < CLASSES) | (key == 2 * CLASSES), count, 0), size)
            # most words occur once: one computation for all with the same neighbours
            once = np.flatnonzero((tokens == 1) & (np.bincount(owner, minlength=size) == 2))
            chosen = np.zeros(size, np.int64)
            code = np.bincount(owner, np.where(key < CLASSES, key * CLASSES, key - CLASSES), size).astype(np.int64)
            code = code[once] * CLASSES + home[once]
            _, first, same = np.unique(code, return_index=True, return_inverse=True)
            rest = np.setdiff1d(np.arange(size), once, assume_unique=True)
            asked = np.sort(np.concatenate([once[first], rest]))
            number = np.full(size, -1)
            number[asked] = np.arange(len(asked))
            own = number[owner] >= 0
            chosen[asked] = best_classes(table, home[asked], number[owner[own]], key[own], count[own])
            chosen[once] = chosen[once[first]][same]
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(tokens.astype(np.int64)), pa.array(chosen.astype(np.int32))], ["word", "n", "class"])

    return run


class Model:
    """What scoring needs: the head, and by item the class, the class's transition and emission denominators (log10)."""

    def __init__(self, head: Head, group: np.ndarray, moves: np.ndarray, per_class: np.ndarray, vocabulary: np.ndarray, tokens: int, kinds: int) -> None:
        """per_class, vocabulary: training tokens and distinct words of each class."""
        self.head, self.group, self.tokens = head, group, tokens
        share = (moves.sum(0) + CLASS_PRIOR) / (moves.sum() + CLASS_PRIOR * len(moves))
        weight = CLASS_PRIOR * len(moves)
        self.step = np.log10((moves + weight * share) / (moves.sum(1, keepdims=True) + weight))
        self.emission = -np.log10(per_class + WORD_PRIOR * (vocabulary + 1))
        self.emission[0] = 0.0  # the end is the only member of its class
        self.base = -math.log10(tokens + 0.5 * (kinds + 1))


#: Marks a token's class as that of its ending, because the word isn't in the head.
TAIL = 128


def _recoded(shared):
    """Sequences with a class a token, and the end's after each text, instead of numbers; TAIL and the ending's class for words beyond the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_class, group = shared.value
        for part in pieces(batches, "codes"):
            tokens = _Tokens(part)
            full, _, starts = _with_ends(tokens.values(head_class, TAIL + group[1 + CLUSTERED + tokens.shapes]), tokens.sizes)
            flat = full.astype(np.uint8).tobytes()
            classes = pa.array([flat[i : i + n + 1] for i, n in zip(starts.tolist(), tokens.sizes.tolist(), strict=True)], pa.binary())
            names = ["doc_id", "row", "held_out", "n_known", "log_sum", "places"]
            rares = pc.list_value_length(part.column("rare")).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), rares, classes], [*names, "rares", "classes"])

    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes, logs and numbers of known tokens with the words beyond the head that training texts have: ``met`` (place among the document's other words * 64 + class) and their counts ``times``."""
    for part in pieces(batches, "classes"):
        place, places = _lists(part.column("places"))
        met, times = part.column("met").flatten().to_numpy(), part.column("times").flatten().to_numpy()
        mets = pc.fill_null(pc.list_value_length(part.column("met")), 0).to_numpy()
        rares = part.column("rares").to_numpy()
        out, known, logs = [], part.column("n_known").to_numpy().copy(), part.column("log_sum").to_numpy().copy()
        b = c = 0
        for i, code in enumerate(part.column("classes").to_pylist()):
            if rares[i]:
                at, mine = place[b : b + places[i]], met[c : c + mets[i]]
                n_r, c_r = np.zeros(rares[i], np.int64), np.zeros(rares[i], np.int64)
                n_r[mine // 64], c_r[mine // 64] = times[c : c + mets[i]], mine % 64
                seq = np.frombuffer(code, np.uint8).copy()
                tail = np.flatnonzero(seq >= TAIL)
                seq[tail] = np.where(n_r[at] > 0, c_r[at], seq[tail] - TAIL)
                code = seq.tobytes()
                known[i] += (n_r[at] > 0).sum()
                logs[i] += np.log10(n_r[at] + WORD_PRIOR).sum()
            b, c = b + places[i], c + mets[i]
            out.append(code)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(known), pa.array(logs), pa.array(out, pa.binary())], ["doc_id", "held_out", "n_known", "log_sum", "classes"])


def _class_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' classes and those before them, the documents' starts and sizes."""
    codes = column.to_pylist()
    sizes = np.array([len(x) for x in codes], np.int64)
    cls = np.frombuffer(b"".join(codes), np.uint8).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    before = np.zeros_like(cls)
    before[1:] = cls[:-1]
    before[starts] = 0
    return cls, before, starts, sizes


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for part in pieces(batches, "classes"):
        cls, before, _, _ = _class_pairs(part.column("classes"))
        total += np.bincount(before * CLASSES + cls, minlength=len(total))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["key", "n"])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        end_log = math.log10(m.ends + WORD_PRIOR)
        for part in pieces(batches, "classes"):
            cls, before, starts, n = _class_pairs(part.column("classes"))
            logs = part.column("log_sum").to_numpy()
            score = np.add.reduceat(m.step[before, cls] + m.emission[cls], starts) + logs
            known = part.column("n_known").to_numpy() + (1 if m.ends else 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), m.tokens)), pa.array(n * m.base + logs + end_log), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def _level(n: str = "n") -> Column:
    """A word's count as a level: the count itself below 2^16, above in 4,096 steps for each doubling. About 260,000 levels at most."""
    return F.when(F.col(n) < 1 << 16, F.col(n)).otherwise((1 << 16) + F.floor((F.log2(n) - 16) * 4096)).cast("long")


def _cut(sizes: pa.Table, room: int) -> tuple[int, int]:
    """Of (level, size), levels falling: the first level that no longer fits, and how much room the ones above leave."""
    level, size = sizes["level"].to_numpy(), sizes["size"].to_numpy()
    order = np.argsort(-level)
    total = np.cumsum(size[order])
    k = int(np.searchsorted(total, room, side="right"))
    return (int(level[order[k]]) if k < len(order) else -(1 << 62)), room - (int(total[k - 1]) if k else 0)


def _most_frequent(counted: DataFrame, most: int) -> tuple[pa.Table, int]:
    """At most ``most`` words of the highest counts, by falling count, and the level that the words beyond don't exceed.

    No sort of all words and no task that meets a part of each: levels are sized first, and in the level where the
    limit falls (words of one count, as a rule) words are taken by hash, whose leading 16 bits are levels again.
    """
    ranked = counted.withColumn("level", _level())
    edge, room = _cut(ranked.groupBy("level").agg(F.count("*").alias("size")).toArrow(), most)
    fine = (-F.shiftright("word", 48)).alias("level")
    last, _ = _cut(ranked.filter(F.col("level") == edge).groupBy(fine).agg(F.count("*").alias("size")).toArrow(), room)
    head = ranked.filter((F.col("level") > edge) | ((F.col("level") == edge) & (-F.shiftright("word", 48) > last))).select("word", "shape", "n").toArrow()
    return head.sort_by([("n", "descending"), ("word", "ascending")]), edge


def class_scores(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lower-cased) and one end. Learns from all documents outside the held-out fold. base_score is
    the smoothed unigram's log10 probability of the text, score the class bigram's; both are sums over all tokens. Words
    are told apart by 64-bit hashes. Null and empty texts are one end token. Rows that repeat doc_id and text get equal
    results and count as often as they occur in training. Without training documents N is 0 and the smoothing decides
    alone. Other columns are ignored; an empty table gives an empty result; texts of any length are scored whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash("text").alias("row"), (fold("doc_id", folds) == held_out).alias("held_out"), "text")
    train = rows.filter("not held_out").select("text")
    counted = train.mapInArrow(_word_counts, "word long, shape int, n long").groupBy("word").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))
    ends = train.count()
    top, edge = _most_frequent(written(counted, "words"), HEAD)
    head = Head(top["word"].to_numpy(), top["n"].to_numpy(), top["shape"].to_numpy())
    shared = spark.sparkContext.broadcast(head)
    sequences = written(rows.mapInArrow(_sequences(shared), SEQUENCES), "sequences")
    learned = sequences.filter("not held_out").select("codes", "rare", "shapes", "places")
    got = learned.mapInArrow(_bigrams(shared), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(ITEMS * ITEMS)
    matrix[got["key"].to_numpy()] = got["n"].to_numpy()
    matrix = matrix.reshape(ITEMS, ITEMS)
    group = exchange(matrix)

    one = np.zeros((ITEMS, CLASSES))
    one[np.arange(ITEMS), group] = 1
    near = learned.mapInArrow(_contexts(spark.sparkContext.broadcast((head, group))), "word long, home byte, near binary")
    near = near.repartition("word").sortWithinPartitions("word")
    classes = written(near.mapInArrow(_classes(spark.sparkContext.broadcast(one.T @ matrix @ one)), "word long, n long, class int"), "classes")

    # tokens and distinct words by class
    own = min(CLUSTERED, len(top))
    per_class, vocabulary = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(per_class, group[1 : 1 + own], top["n"].to_numpy()[:own])
    np.add.at(vocabulary, group[1 : 1 + own], 1)
    for r in classes.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # CLASSES rows
        per_class[r["class"]] += r["n"]
        vocabulary[r["class"]] += r["v"]
    per_class[0], vocabulary[0] = ends, 1 if ends else 0
    total = int(per_class.sum())
    # the head's further words, at most HEAD
    head_class = group[head.items]
    further = classes.join(F.broadcast(spark.createDataFrame(top.select(["word"]))), "word").select("word", "class").toArrow()
    head_class[np.searchsorted(head.words, further["word"].to_numpy())] = further["class"].to_numpy()

    # the hash of the text tells texts apart, so any id can stand for null; equal rows bring the same words, once
    key = (F.coalesce("doc_id", F.lit(-1)).alias("id"), "row")
    rare = sequences.select(*key, F.posexplode("rare").alias("place", "word")).repartition("word").dropDuplicates(["word", "id", "row"])
    tail = classes.filter(_level() <= edge)
    met = rare.join(tail.hint("merge"), "word").groupBy("id", "row").agg(F.collect_list(F.col("place") * 64 + F.col("class")).alias("met"), F.collect_list("n").alias("times"))
    recoded = sequences.mapInArrow(_recoded(spark.sparkContext.broadcast((head_class, group))), "doc_id long, row long, held_out boolean, n_known long, log_sum double, places array<int>, rares int, classes binary")
    joined = recoded.withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(met.hint("merge"), ["id", "row"], "left").select(*recoded.columns, "met", "times")
    filled = written(joined.mapInArrow(_filled, "doc_id long, held_out boolean, n_known long, log_sum double, classes binary"), "filled")
    got = filled.filter("not held_out").select("classes").mapInArrow(_moves, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    moves = np.zeros(CLASSES * CLASSES)
    moves[got["key"].to_numpy()] = got["n"].to_numpy()
    model = Model(head, group, moves.reshape(CLASSES, CLASSES), per_class, vocabulary, total, int(vocabulary.sum()))
    model.ends = ends
    model.head = None  # the sequences hold what scoring needs of it
    return filled.mapInArrow(_scored(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
