"""A compressed FM-index over words, and matching statistics by backward search.

The text is a sequence of word numbers in which 0 ends a string.  The index holds
the Burrows-Wheeler transform of the text in a Huffman-shaped wavelet tree (about
as many bits a word as the words' entropy, each level a packed bitmap with block
ranks, all zeros before all ones), the first place of each word, and where suffixes cease to share their
first words.  Suffixes are ordered by ``limit`` + 1 words at least, which is all
that searches for matches of ``limit`` words look at.

Many patterns are searched side by side: every step is a few numpy operations on
all of them.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` ordered by their first ``depth`` numbers (at least), by prefix doubling.

    The first sort packs as many words into a key as go in; later rounds sort only
    places that are not yet told apart.
    """
    n = len(text)
    bits, symbol_bits = n.bit_length(), max(1, int(text.max()).bit_length())
    if 3 * bits > 63:
        raise ValueError("an index has at most 2**21 - 1 words")
    h = max(1, min(depth, (63 - bits) // symbol_bits))
    padded = np.r_[text.astype(np.int64), np.zeros(h, np.int64)]
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key << symbol_bits | padded[j: j + n]
    key = np.sort(key << bits | np.arange(n))
    mask = (1 << bits) - 1
    order = key & mask
    new = np.r_[True, key[1:] >> bits != key[:-1] >> bits]
    rank = np.zeros(n + 1, np.int64)                      # 0: beyond the end
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    while h < depth:
        slot = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(slot):
            break
        at = order[slot]
        key = np.sort(rank[at] << 2 * bits | rank[np.minimum(at + h, n)] << bits | at)
        at = key & mask
        order[slot] = at
        new[slot] = np.r_[True, key[1:] >> bits != key[:-1] >> bits]
        rank[at] = np.maximum.accumulate(np.where(new[slot], slot, 0)) + 1
        h *= 2
    return order


def code_lengths(frequency: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code.

    No joined node weighs less than the two lightest together, so all nodes that
    weigh no more than that are joined in one round, neighbours by weight.
    """
    n = len(frequency)
    if n == 1:
        return np.ones(1, np.int64)
    node = np.argsort(frequency, kind="stable")
    weight = frequency[node]
    parent, made, rounds = np.zeros(2 * n - 1, np.int64), n, [n]
    while len(node) > 1:
        pairs = int(np.searchsorted(weight, weight[0] + weight[1], "right")) // 2
        new = made + np.arange(pairs)
        parent[node[: 2 * pairs]] = np.repeat(new, 2)
        joined = weight[: 2 * pairs].reshape(-1, 2).sum(1)
        made += pairs
        rounds.append(made)
        at = np.searchsorted(weight[2 * pairs:], joined, "right")
        weight, node = np.insert(weight[2 * pairs:], at, joined), np.insert(node[2 * pairs:], at, new)
    depth = np.zeros(2 * n - 1, np.int64)
    for low, high in zip([0, *rounds][-2::-1], rounds[::-1]):      # parents are made in later rounds
        of = slice(low, min(high, 2 * n - 2))
        depth[of] = depth[parent[of]] + 1
    return depth[:n]


class WaveletTree:
    """Ranks in a sequence of numbers 0 .. size - 1, all of which occur."""

    def __init__(self, sequence: np.ndarray, size: int):
        frequency = np.bincount(sequence, minlength=size)
        self.length = code_lengths(frequency)
        canonical = np.lexsort((np.arange(size), self.length))
        sorted_length = self.length[canonical]
        deepest = int(sorted_length[-1])
        step = np.left_shift(1, deepest - sorted_length)           # leaves of the full tree under each code
        left = np.cumsum(step) - step
        self.code = np.empty(size, np.int32)                       # filled up with zeros to the longest
        self.code[canonical] = left
        self.short = (deepest - self.length).astype(np.uint8)       # how much shorter than the longest code
        self.short_at = np.arange(deepest, 0, -1)                  # of the codes that end at each level
        self.bits, self.blocks = [], []
        self.node = np.zeros((deepest, size), np.int64)            # where the symbol's node begins at each level, and the ones before that
        rest, here = self.code[sequence], canonical                # codes that go on, and their symbols, in the order of the level
        for level in range(deepest):
            mask = 1 << (deepest - 1 - level)
            prefix, bit = self.code[here] >> (deepest - level), rest & mask != 0
            first = np.maximum.accumulate(np.where(np.r_[True, prefix[1:] != prefix[:-1]], np.arange(len(here)), 0))
            begin = (np.cumsum(frequency[here]) - frequency[here])[first]
            self._add(bit)
            self.node[level, here] = begin << 32 | np.r_[0, np.cumsum(bit)][begin]
            # All zeros, then all ones; codes that end here drop out: they are the smallest.
            cut = int(np.searchsorted(sorted_length, level + 1, "right"))
            if cut < size:
                live, branch = self.code[here] >= left[cut], self.code[here] & mask != 0
                here = np.r_[here[~branch & live], here[branch & live]]
                live = rest >= left[cut]
                rest = np.r_[rest[~bit & live], rest[bit & live]]

    def _add(self, bit: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
        padded[: len(bit)] = bit
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.bits.append(words)
        self.blocks.append((np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)).astype(np.int32))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before the place beside it, and whether it stands there."""
        order = np.argsort(self.short[symbol], kind="stable")             # long codes first: those still on their way are a prefix
        symbol, out, stands = symbol[order], place[order].astype(np.int64), np.ones(len(symbol), bool)
        code = self.code[symbol]
        live = np.searchsorted(self.short[symbol], self.short_at)
        for level, k in enumerate(live.tolist()):
            if not k:
                break
            pos, node = out[:k], self.node[level][symbol[:k]]
            at = (node >> 32) + pos
            block, here = at >> 6, np.left_shift(1, at & 63).view(np.uint64)
            word = self.bits[level][block]
            bit = code[:k] & (1 << (len(live) - 1 - level)) != 0
            ones = self.blocks[level][block] + np.bitwise_count(word & (here - _ONE)) - (node & 0xFFFFFFFF)
            stands[:k] &= (word & here != 0) == bit
            out[:k] = np.where(bit, ones, pos - ones)
        ranks, there = np.empty_like(out), np.empty_like(stands)
        ranks[order], there[order] = out, stands
        return ranks, there

    def n_bytes(self) -> int:
        return sum(b.nbytes + k.nbytes for b, k in zip(self.bits, self.blocks))


class FMIndex:
    """Index of a text (0 ends each string) for matches of ``limit`` words."""

    def __init__(self, text: np.ndarray, limit: int):
        if not len(text) or text[-1] != 0:
            raise ValueError("a text ends with the number 0")
        self.limit, self.n = limit, len(text)
        self.symbols, dense = np.unique(text, return_inverse=True)          # 0 stays 0
        self.order = suffix_order(dense, limit + 1)
        self.tree = WaveletTree(dense[self.order - 1], len(self.symbols))
        count = np.bincount(dense, minlength=len(self.symbols))
        self.first = np.cumsum(count) - count
        shared = self._shared(dense)
        # The places where suffixes stop sharing d words, for each d: ends of the intervals of matches of d words.
        self.ends = [np.r_[np.flatnonzero(shared < d), self.n] if d else np.array([0, self.n]) for d in range(limit + 1)]
        self.shared = np.r_[shared, 0]
        self.shared[0] = 0
        self.group = np.cumsum(shared < limit) - 1                          # of each place in the order
        self.group_first = self.ends[limit][:-1]
        self._heads(dense)

    def _heads(self, dense: np.ndarray) -> None:
        """A table of the first words of suffixes, as many as a number holds: searches begin from it."""
        self.head_bits = max(1, (len(self.symbols) - 1).bit_length())
        self.head = max(1, min(self.limit, 62 // self.head_bits))
        padded = np.r_[dense, np.zeros(self.head, dense.dtype)].astype(np.int64)
        self.heads = np.zeros(len(self.ends[self.head]) - 1, np.int64)
        for j in range(self.head):
            self.heads = self.heads << self.head_bits | padded[self.order[self.ends[self.head][:-1]] + j]

    def _shared(self, dense: np.ndarray) -> np.ndarray:
        """Words shared with the suffix before, ``limit`` at most; -1 at the first.  An end of string is never shared."""
        padded = np.r_[dense, np.zeros(self.limit + 1, dense.dtype)]
        shared = np.zeros(self.n, np.int64)
        live = np.arange(1, self.n)
        for j in range(self.limit):
            a = padded[self.order[live] + j]
            live = live[(a == padded[self.order[live - 1] + j]) & (a > 0)]
            shared[live] = j + 1
        shared[0] = -1
        return shared

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The index's own numbers of some word numbers; -1 for those that it does not have."""
        at = np.minimum(np.searchsorted(self.symbols, words), len(self.symbols) - 1)
        return np.where((self.symbols[at] == words) & (words > 0), at, -1)

    def _step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one more word in front."""
        wide = np.flatnonzero(high - low > 1)
        ranks, stands = self.tree.rank(np.r_[symbol, symbol[wide]], np.r_[low, high[wide]])
        first, k = self.first[symbol], len(symbol)
        new_low = first + ranks[:k]
        new_high = new_low + stands[:k]                    # an interval of one place: the word stands before it or not
        new_high[wide] = first[wide] + ranks[k:]
        return new_low, new_high

    def _widen(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> None:
        """Shortens matches at their end to the next length with a larger interval (in place)."""
        length[:] = np.minimum(np.maximum(self.shared[low], self.shared[np.minimum(high, self.n)]), length - 1)
        for d in np.unique(length).tolist():
            of = np.flatnonzero(length == d)
            ends = self.ends[d]
            at = np.searchsorted(ends, low[of], "right") - 1
            low[of], high[of] = ends[at], ends[at + 1]

    def matching_statistics(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) for each position of the patterns laid end to end.

        ``length``: the words from there on that also stand together in the text,
        ``limit`` at most and within the pattern; ``place``: where that is ``limit``,
        a place in the order where a suffix begins with them (its ``group`` names the
        match).  Patterns hold the text's word numbers; any other matches nothing.
        """
        number = self.numbers(flat)
        size, q = np.diff(offsets), self.head
        length_at, place_at = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        low, high, length = np.zeros(len(size), np.int64), np.full(len(size), self.n), np.zeros(len(size), np.int64)
        # A pattern whose last q words stand in the table begins there.
        long = np.flatnonzero(size >= q)
        key, known = np.zeros(len(long), np.int64), np.ones(len(long), bool)
        for j in range(q):
            c = number[offsets[1:][long] - q + j]
            key, known = key << self.head_bits | np.maximum(c, 0), known & (c >= 0)
        at = np.minimum(np.searchsorted(self.heads, key), len(self.heads) - 1)
        known &= self.heads[at] == key
        long, at = long[known], at[known]
        low[long], high[long], length[long] = self.ends[q][at], self.ends[q][at + 1], q
        for j in range(q):
            length_at[offsets[1:][long] - q + j] = q - j
        place_at[offsets[1:][long] - q] = low[long]
        for lanes, step in ((long, q), (np.flatnonzero(length == 0), 0)):
            self._search(number, offsets, lanes, step, (low[lanes], high[lanes], length[lanes]), length_at, place_at)
        return length_at, place_at

    def _search(self, number: np.ndarray, offsets: np.ndarray, patterns: np.ndarray, done: int, state: tuple[np.ndarray, np.ndarray, np.ndarray],
                length_at: np.ndarray, place_at: np.ndarray) -> None:
        """Backward search of the patterns side by side, from their last ``done`` words on, whose matches ``state`` holds."""
        size = np.diff(offsets)[patterns]
        lanes = np.argsort(-size, kind="stable")
        end, todo = offsets[1:][patterns][lanes], size[lanes]
        low, high, length = (x[lanes] for x in state)
        for step in range(done, int(todo[0]) if len(todo) else 0):
            k = int(np.searchsorted(-todo, -step, "left"))             # patterns longer than the step
            at = end[:k] - 1 - step
            lo, hi, ln = low[:k], high[:k], length[:k]                 # views: the state is written through
            c = number[at]
            live = np.flatnonzero(c >= 0)
            if len(live) < k:
                lo[c < 0], hi[c < 0], ln[c < 0] = 0, self.n, 0
            while len(live):
                a, b = self._step(c[live], lo[live], hi[live])
                found = a < b
                grow, a, b = live[found], a[found], b[found]
                grown = ln[grow] + 1
                over = grown > self.limit
                if over.any():                                          # a match of limit + 1: back to the interval of its first limit words
                    g = self.group[a[over]]
                    a[over], b[over] = self.ends[self.limit][g], self.ends[self.limit][g + 1]
                lo[grow], hi[grow], ln[grow] = a, b, np.minimum(grown, self.limit)
                live = live[~found]
                if len(live):
                    x, y, z = lo[live], hi[live], ln[live]
                    self._widen(x, y, z)
                    lo[live], hi[live], ln[live] = x, y, z
            length_at[at], place_at[at] = ln, lo
