"""Elias-Fano lists and the levels of an n-gram trie made of them, laid out in one memory map."""

from __future__ import annotations

import mmap

import numpy as np

STEP = 256
CHILD_BITS = 40
CHILD_MASK = np.uint64((1 << CHILD_BITS) - 1)
#: Quantised log10 probabilities: code 0 is an unseen n-gram, codes 1 to 255 go from LOWEST to 0 in equal steps.
LOWEST = -9.0
PROBABILITY = np.concatenate([[0.0], 10.0 ** np.linspace(LOWEST, 0.0, 255)])


def quantised(probability: np.ndarray) -> np.ndarray:
    """The code of the largest step that is not above each probability, so that what a context gives away never sums to more."""
    return np.maximum(np.searchsorted(PROBABILITY, probability, "right") - 1, 0).astype(np.uint8)


#: Quantised counts: code 0 is an unseen n-gram, 1 to 64 are exact, then equal steps of the logarithm up to 2 ** 40.
COUNT = np.concatenate([np.arange(65.0), np.floor(2.0 ** np.linspace(6, 40, 192)[1:])])


def quantised_count(count: np.ndarray) -> np.ndarray:
    """The code of the largest step that is not above each count."""
    return (np.searchsorted(COUNT, count, "right") - 1).astype(np.uint8)


class EliasFano:
    """A rising list of 64-bit numbers: high parts in unary, low parts in whole bytes.

    Every STEP-th value and its place in the unary part is kept as a skip pointer, so that a run of
    values is decoded without what stands before it.
    """

    FIELDS = ("shape", "low", "high", "sample", "place")

    def __init__(self, fields: dict[str, np.ndarray]):
        self.fields = fields
        self.size, self.low_bytes = (int(x) for x in fields["shape"])

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        size = len(values)
        spread = int(values[-1]) // size if size else 0
        low_bytes = min(7, -(-spread.bit_length() // 8))
        high = (values >> np.uint64(8 * low_bytes)).astype(np.int64)
        place = high + np.arange(size)
        bits = np.zeros(int(place[-1]) + 1 if size else 0, np.uint8)
        bits[place] = 1
        low = values.view(np.uint8).reshape(size, 8)[:, :low_bytes]
        return cls({
            "shape": np.array([size, low_bytes], np.int64), "low": np.ascontiguousarray(low).reshape(-1), "high": np.packbits(bits, bitorder="little"),
            "sample": values[::STEP], "place": place[::STEP].astype(np.int64),
        })

    def decode(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last - 1``; ``first`` is a multiple of STEP."""
        last = min(last, self.size)
        if first >= last:
            return np.zeros(0, np.uint64)
        places = self.fields["place"]
        start = int(places[first // STEP])
        stop = int(places[-(-last // STEP)]) if -(-last // STEP) < len(places) else 8 * len(self.fields["high"])
        bits = np.unpackbits(self.fields["high"][start // 8 : -(-stop // 8)], bitorder="little")
        ones = np.flatnonzero(bits[start % 8 :])[: last - first] + start
        out = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(8 * self.low_bytes)
        low = np.zeros((last - first, 8), np.uint8)
        low[:, : self.low_bytes] = self.fields["low"][first * self.low_bytes : last * self.low_bytes].reshape(last - first, self.low_bytes)
        return out | low.view(np.uint64).reshape(-1)

    def successor(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rising ``queries``: index of the first value that is not smaller (``size`` if none), and whether it is equal."""
        index = np.full(len(queries), self.size, np.int64)
        equal = np.zeros(len(queries), bool)
        sample = self.fields["sample"]
        for at in range(0, len(queries), 1 << 16):
            part = queries[at : at + (1 << 16)]
            if not self.size:
                break
            first = max(int(np.searchsorted(sample, part[0], "left")) - 1, 0) * STEP
            last = (int(np.searchsorted(sample, part[-1], "right")) + 1) * STEP
            values = self.decode(first, last)
            found = np.searchsorted(values, part, "left")
            inside = found < len(values)
            equal[at : at + len(part)] = inside & (values[np.minimum(found, len(values) - 1)] == part)
            index[at : at + len(part)] = found + first
        return index, equal


class NgramTrie:
    """Contexts (words or bigrams), pointers to their children and quantised probabilities or counts of the children.

    Level 1 lists context hashes. The pointers, a rising list, give each context its run of children. A child is
    stored relative to its context (its number above CHILD_BITS of the word's hash), so the list of all
    children rises; a search decodes the run that the pointers give and compares the part within the context.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, children: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.children, self.codes = contexts, pointers, children, codes

    @classmethod
    def build(cls, context: np.ndarray, child: np.ndarray, codes: np.ndarray) -> NgramTrie:
        """From n-grams sorted by context, then child (CHILD_BITS bits)."""
        distinct, number, count = np.unique(context, return_inverse=True, return_counts=True)
        relative = (number.astype(np.uint64) << np.uint64(CHILD_BITS)) | child
        ends = np.concatenate([[0], np.cumsum(count)])
        return cls(EliasFano.build(distinct), EliasFano.build(ends), EliasFano.build(relative), codes).mapped()

    def mapped(self) -> NgramTrie:
        """The same trie with all levels in one anonymous memory map."""
        parts = [(level, name, level.fields[name]) for level in (self.contexts, self.pointers, self.children) for name in EliasFano.FIELDS]
        arrays = [a for _, _, a in parts] + [self.codes]
        starts = np.concatenate([[0], np.cumsum([-(-a.nbytes // 8) * 8 for a in arrays])]).astype(int)
        area = mmap.mmap(-1, max(int(starts[-1]), 8))

        def placed(array: np.ndarray, start: int) -> np.ndarray:
            view = np.frombuffer(area, array.dtype, array.size, start)
            view[:] = array
            view.flags.writeable = False
            return view

        views = [placed(a, s) for a, s in zip(arrays, starts)]
        levels: dict[int, dict] = {}
        for (level, name, _), view in zip(parts, views):
            levels.setdefault(id(level), {})[name] = view
        a, b, c = (EliasFano(levels[id(x)]) for x in (self.contexts, self.pointers, self.children))
        self.bytes = int(starts[-1])
        out = NgramTrie(a, b, c, views[-1])
        out.bytes = self.bytes
        return out

    def lookup(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Codes of n-grams sorted by context, then child; 0 where the n-gram is not in the trie.

        The pointers give each context its run of children, and the successor of a child is searched in that run alone.
        """
        number, known = self.contexts.successor(context)
        out = np.zeros(len(context), np.uint8)
        asked = np.flatnonzero(known)
        for at in range(0, len(asked), 1 << 16):
            part = asked[at : at + (1 << 16)]
            first, last = self.runs(number[part])
            begin = int(first[0]) // STEP * STEP
            values = self.children.decode(begin, int(last[-1])) & CHILD_MASK
            low, high = first - begin, last - begin
            want, stop = child[part], high
            while (searched := low < high).any():
                middle = np.minimum((low + high) // 2, len(values) - 1)
                smaller = values[middle] < want
                low, high = np.where(searched & smaller, middle + 1, low), np.where(searched & ~smaller, middle, high)
            hit = (low < stop) & (values[np.minimum(low, len(values) - 1)] == want)
            out[part[hit]] = self.codes[low[hit] + begin]
        return out

    def runs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last child of each context, given by rising numbers."""
        begin = int(numbers[0]) // STEP * STEP
        ends = self.pointers.decode(begin, int(numbers[-1]) + 2).astype(np.int64)
        return ends[numbers - begin], ends[numbers - begin + 1]
