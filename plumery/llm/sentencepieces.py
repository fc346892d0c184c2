"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merging starts from single characters; an agenda holds all pairs of neighbours that form a piece, best piece first, leftmost
first among equals. Candidate merges are numbered as the agenda meets them, and each is skipped with the dropout's rate: a
hash keyed by seed, document, the word's place in it and the number of the draw gives how many candidates pass before the next
one that is skipped, which is the same as one draw for each candidate. So one seed always gives the same segmentation, and each
occurrence of a word is drawn by itself. A document is known by a hash of its text: equal texts have equal ids. With rate 0
the ids are the model's own.

No piece has a blank behind another character (nor, in most models, a newline), so words with the blanks before them merge by
themselves. What a word's agenda does depends on nothing but the numbers of the skipped candidates; so runs of words that come
often are remembered as a tree: a word's root is its run without skips, and a run has a child for each number that may be
skipped next. An occurrence walks down by its own draws. Runs that aren't known yet, and all those of rare words, go through
their agendas side by side, in arrays.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumery.llm.common import runs_of, small_batches, table

BLANK = "▁"
MARK, SIGN = "\ud800", "\ud801"
#: Longer words go through a heap instead of the side-by-side agendas.
LONG_WORD = 256
NO_MERGE, FREE = 1 << 30, np.iinfo(np.int64).min
#: A word's runs are remembered from so many uses on, and if it hasn't more characters than that.
OFTEN, REMEMBERED_LENGTH = 6, 24
CHUNK_CHARS = 300_000


class Runs:
    """Agenda runs: ids, number of candidate merges and, for each that may be skipped next, the run that it leads to."""

    def __init__(self):
        self.words = Words()
        self.word_of: list[str] = []
        self.skips: list[tuple[int, ...]] = []
        self.n, self.n_ids, self.n_ways = 0, 0, 0
        self.at, self.size, self.count, self.ways_at, self.depth = (np.zeros(1 << 12, np.int64) for _ in range(5))
        self.ids, self.ways = np.zeros(1 << 14, np.uint16), np.zeros(1 << 14, np.int32)
        #: Of each word's number: how often it came, and its run without skips (-1: not remembered).
        self.uses, self.root = np.zeros(1 << 12, np.int64), np.full(1 << 12, -1)

    def met(self, words: Iterator[str], n: int) -> np.ndarray:
        """The numbers of n words, whose uses are counted."""
        found = np.fromiter(map(self.words.__getitem__, words), np.int64, n)
        m = len(self.uses)
        self.uses, self.root = _grown(self.uses, len(self.words)), _grown(self.root, len(self.words))
        self.root[m:] = -1
        self.uses += np.bincount(found, minlength=len(self.uses))
        return found

    def forget_rare(self) -> None:
        """Words without remembered runs go; the others get new numbers."""
        often = np.flatnonzero(self.root[: len(self.words)] >= 0)
        all_words = list(self.words)
        self.words = Words(zip(map(all_words.__getitem__, often.tolist()), range(len(often)), strict=True))
        self.uses, self.root = self.uses[often], self.root[often]

    def add(self, words: list[str], skips: list[tuple[int, ...]], ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of the new runs, whose ids stand one after another."""
        n, m, i, w = self.n, self.n + len(sizes), self.n_ids + len(ids), self.n_ways + int(counts.sum())
        self.at, self.size, self.count, self.ways_at, self.depth = (_grown(x, m) for x in (self.at, self.size, self.count, self.ways_at, self.depth))
        self.depth[n:m] = np.fromiter(map(len, skips), np.int64, m - n)
        self.ids, self.ways = _grown(self.ids, i), _grown(self.ways, w)
        self.at[n:m], self.size[n:m], self.count[n:m], self.ways_at[n:m] = self.n_ids + np.cumsum(sizes) - sizes, sizes, counts, self.n_ways + np.cumsum(counts) - counts
        self.ids[self.n_ids : i], self.ways[self.n_ways : w] = ids, -1
        self.word_of += words
        self.skips += skips
        self.n, self.n_ids, self.n_ways = m, i, w
        return np.arange(n, m)


class Words(dict):
    """Words by number: one asked for the first time gets the next."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])


def _gathered(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat from ``at`` on, one after another."""
    return flat[np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]


def _packed(skips: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers one after another, and how many each one has."""
    sizes = np.fromiter(map(len, skips), np.int64, len(skips))
    return np.fromiter(chain.from_iterable(skips), np.int64, int(sizes.sum())), sizes


def _mixed(z: np.ndarray) -> np.ndarray:
    """splitmix64's last steps."""
    with np.errstate(over="ignore"):
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


@cache
def _steps(rate: float) -> np.ndarray:
    """The chances, of 2^53, that at least 1, 2, ... candidates pass before one is skipped, ascending."""
    if not 1e-5 <= rate <= 1:
        raise ValueError("a dropout rate is 0, or from 0.00001 to 1")
    n = 1 if rate == 1 else int(37 / -math.log1p(-rate)) + 1
    return np.array(sorted(int((1 - rate) ** k * (1 << 53)) for k in range(1, n + 1)), np.uint64)


def passed(keys: np.ndarray, draw: int | np.ndarray, rate: float) -> np.ndarray:
    """How many candidates pass before the next skipped one, in the draw of that number of each occurrence."""
    with np.errstate(over="ignore"):
        u = _mixed(keys + (np.asarray(draw).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    steps = _steps(rate)
    return len(steps) - np.searchsorted(steps, u, "right")


class Pieces:
    """A BPE model's pieces, as tables."""

    def __init__(self, path: str, remember: int = 60_000):
        """remember: how many words a worker counts before the rare ones go. If more than half are left, or it has more runs than that, it begins anew."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids of more than 16 bits aren't supported")
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, np.int64)
        usable = {}
        for i in range(n):
            if model.is_byte(i):
                self.bytes[int(self.text[i][1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                usable[self.text[i]] = i
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in usable) or (self.bytes < 0).any():
            raise ValueError("the model must have byte pieces and no blank inside a piece")
        order = sorted(usable.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        merges = sorted(((usable[p[:k]] << 16 | usable[p[k:]], rank[i]) for p, i in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable))
        self.id_of = np.array(order, np.int32)  # of each rank
        bits = (4 * len(merges)).bit_length()
        self.last, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.slots = np.full(1 << bits, FREE)  # pair and rank
        keys, ranks = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        at = self._home(keys)
        while len(keys):  # open addressing
            free = self.slots[at] == FREE
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.slots[at[first]] = keys[first] << 16 | ranks[first]
            left = np.setdiff1d(np.arange(len(keys)), first)
            keys, ranks, at = keys[left], ranks[left], at[left] + 1 & self.last
        self.chars = {p: i for p, i in usable.items() if len(p) == 1}
        self.by_lines = not any("\n" in p for p in usable)
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.chars.items():
            self.char_ids[ord(p)] = i
        alone = np.flatnonzero(self.char_ids[:128] < 0)  # written as one byte's piece, which never merges
        self.char_ids[alone] = self.bytes[alone]
        self.out = [b""] * n
        for p, i in usable.items():
            self.out[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.out[i] = bytes([b])
        self.memo = Runs()
        self.remember = remember

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (NO_MERGE: none) of the piece that two neighbours form; negative ones form none."""
        keys = left.astype(np.int64) << 16 | right
        at = self._home(keys)
        here = self.slots[at]
        hit = here >> 16 == keys
        rank = np.where(hit, here & 0xFFFF, NO_MERGE).astype(np.int32)
        todo = np.flatnonzero(~hit & (here != FREE))
        keys, at = keys[todo], at[todo]
        while len(todo):
            at = at + 1 & self.last
            here = self.slots[at]
            hit = here >> 16 == keys
            rank[todo[hit]] = here[hit] & 0xFFFF
            on = ~hit & (here != FREE)
            todo, keys, at = todo[on], keys[on], at[on]
        return rank

    # --- agenda -------------------------------------------------------------------------------------------------------

    def segment(self, words: list[str], skips: np.ndarray, n_skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of words with the given candidates skipped: all their ids, and each one's number of ids and of candidates.

        skips has the numbers of each word's skipped candidates, ascending, and n_skips how many they are. Words go side by side,
        about equally long ones together.
        """
        chars, starts, lengths = self._forms(words)
        skip_at = np.cumsum(n_skips) - n_skips
        order = np.argsort(lengths, kind="stable")
        ascending, at, found = lengths[order], 0, []
        while at < len(order):
            width = int(ascending[at])
            if width > LONG_WORD:
                end, k = at + 1, order[at]
                found.append(self._segment_long(_text(chars[starts[k] : starts[k] + width]), skips[skip_at[k] : skip_at[k] + n_skips[k]].tolist()))
            else:
                end = min(int(np.searchsorted(ascending, min(width + width // 4, LONG_WORD), "right")), at + max(1, 200_000 // width))
                part = order[at:end]
                found.append(self._agenda(chars, starts[part], lengths[part], _gathered(skips, skip_at[part], n_skips[part]), n_skips[part]))
            at = end
        ids, sizes, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return _gathered(ids, (np.cumsum(sizes) - sizes)[place], sizes[place]), sizes[place], counts[place]

    def _agenda(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, skips: np.ndarray, n_skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and the number of ids and of candidates of each word.

        Symbols of a word are linked; a symbol's place, in its word's row, is where it starts, and holds the rank of its merge with
        the next. A row has a place more than its word, at which nothing merges.
        """
        n, width = len(starts), int(lengths.max()) + 1
        inside = np.arange(width) < lengths[:, None]
        ids = np.full(n * width, -2, np.int32)  # -2: nothing, -1: a character without a piece
        ids[inside.ravel()] = self.char_ids[_gathered(chars, starts, lengths)]
        after = np.arange(1, n * width + 1)  # where the next symbol starts, so where this one ends
        before = after - 2
        before[::width] = -1
        ranks = np.full((n, width), NO_MERGE, np.int32)
        rank = ranks.ravel()
        seen = np.zeros(n, np.int64)
        # A word has fewer than three candidates for each character.
        most, skipped = 3 * width, np.zeros(3 * n * width, bool)
        own = skips < most
        skipped[np.repeat(np.arange(n), n_skips)[own] * most + skips[own]] = True

        def offer(row: np.ndarray, at: np.ndarray, many: bool = False) -> None:
            """Rank the merges of the symbols at these places of rows (ascending; once each, unless many) with the next ones."""
            new = self.merge_of(ids[at], ids[after[at]])
            some = np.flatnonzero(new < NO_MERGE)
            own = row[some]
            number = seen[own]
            if many:
                added = np.bincount(own, minlength=n)
                number = np.arange(len(own)) - (np.cumsum(added) - added)[own]
                seen[:] += added
            else:
                seen[own] += 1
            new[some[skipped[own * most + number]]] = NO_MERGE
            rank[at] = new

        offer(np.repeat(np.arange(n), lengths), np.flatnonzero(inside), many=True)
        rows = np.arange(n)
        while len(rows):
            at = rows * width + ranks[rows].argmin(1)
            best = rank[at]
            go = best < NO_MERGE
            rows, at = rows[go], at[go]
            gone = after[at]
            ids[at], ids[gone], rank[gone] = self.id_of[best[go]], -2, NO_MERGE
            after[at] = end = after[gone]
            before[end] = at
            offer(rows, at)
            left = before[at]
            has = left >= 0
            offer(rows[has], left[has])
        ids = ids.reshape(n, width)
        alive = ids > -2
        bare = np.flatnonzero((ids == -1).any(1)).tolist()
        if not bare:
            return ids[alive].astype(np.uint16), alive.sum(1), seen
        own = [ids[r, alive[r]].astype(np.uint16) for r in range(n)]
        for r in bare:
            places = np.flatnonzero(alive[r])
            own[r] = self._written(_text(chars[starts[r] : starts[r] + lengths[r]]), ids[r, places].tolist(), places.tolist())
        return np.concatenate(own), np.fromiter(map(len, own), np.int64, n), seen

    def _written(self, word: str, ids: list[int], starts: list[int]) -> np.ndarray:
        """Characters without a piece become their bytes' pieces."""
        if -1 in ids:
            whole = []
            for i, a in zip(ids, starts, strict=False):
                whole += [i] if i >= 0 else self.bytes[list(word[a].replace(SIGN, BLANK).encode())].tolist()
            ids = whole
        return np.array(ids, np.uint16)

    def _segment_long(self, word: str, skips: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same agenda as a heap over linked symbols, for one long word."""
        n = len(word)
        ids, end = self.char_ids[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist(), list(range(1, n + 1))
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        seen, skipped = 0, set(skips)
        heap: list[tuple[int, int, int, int]] = []
        slots, shift = memoryview(self.slots), int(self.shift)

        def offer(a: int, b: int) -> None:
            nonlocal seen
            if ids[a] < 0 or ids[b] < 0:
                return
            key = ids[a] << 16 | ids[b]
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> shift
            while (here := slots[at]) >> 16 != key:
                if here == FREE:
                    return
                at = at + 1 & self.last
            if seen not in skipped:
                heapq.heappush(heap, (here & 0xFFFF, a, end[a], end[b]))
            seen += 1

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            best, a, mid, stop = heapq.heappop(heap)
            if not alive[a] or end[a] != mid or mid >= n or not alive[mid] or end[mid] != stop:
                continue
            ids[a], end[a], alive[mid], after[a] = int(self.id_of[best]), stop, False, after[mid]
            if after[a] < n:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        left = [k for k in range(n) if alive[k]]
        out = self._written(word, [ids[k] for k in left], left)
        return out, np.array([len(out)]), np.array([seen])

    # --- texts --------------------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """Words that merge by themselves, each with the blanks before it: a blank stands before the text as well.

        Where no piece holds a newline, a newline begins a word without a blank. In texts with a blank sign, or with blanks in
        a row, before a newline or at an end, blanks are marked by one lone surrogate and blank signs by another; valid text
        has neither.
        """
        if BLANK in text or "  " in text or text.startswith(" ") or text.endswith(" ") or " \n" in text:
            cut = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n[^{MARK}\n]*" if self.by_lines else f"{MARK}*[^{MARK}]+|{MARK}+"
            return re.findall(cut, MARK + text.replace(BLANK, SIGN).replace(" ", MARK))
        return (text.replace("\n", " \n") if self.by_lines else text).split(" ")

    def encode(self, texts: list[str], seed: int, rate: float) -> list[np.ndarray]:
        """Ids of each text; empty texts have none."""
        cut = [self.words(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        runs = self.memo
        full = len(runs.words) > self.remember
        if full:
            runs.forget_rare()
        if max(2 * len(runs.words) if full else 0, runs.n) > self.remember:
            runs = self.memo = Runs()
        flat = list(chain.from_iterable(cut))
        found = runs.met(flat, len(flat))
        keys = self._keys(texts, sizes, seed) if rate > 0 else None
        often, first = np.unique(np.where((runs.uses[found] >= OFTEN) & (runs.root[found] < 0), found, -1), return_index=True)
        words = [(n, w) for n, w in zip(often.tolist(), map(flat.__getitem__, first.tolist()), strict=True) if n >= 0 and len(w) <= REMEMBERED_LENGTH]
        if words:
            names = [w for _, w in words]
            skips = [()] * len(names)
            runs.root[[n for n, _ in words]] = runs.add(names, skips, *self.segment(names, *_packed(skips)))
        run, own = runs.root[found], np.flatnonzero(runs.root[found] < 0)
        if rate > 0:
            own = np.concatenate([own, self._descend(runs, run, keys, rate)])
        at, ids_of_each = runs.at[run], runs.size[run]
        if len(own):  # an agenda for each of these occurrences
            words = list(map(flat.__getitem__, own.tolist()))
            skips, n_skips = self._skips(keys[own], words, rate) if rate > 0 else _packed([()] * len(words))
            own_ids, own_sizes, counts = self.segment(words, skips, n_skips)
            own_at = np.cumsum(own_sizes) - own_sizes
            at[own], ids_of_each[own] = runs.n_ids + own_at, own_sizes
            ids = _gathered(np.concatenate([runs.ids[: runs.n_ids], own_ids]), at, ids_of_each)
            self._keep(runs, run[own], words, skips, n_skips, own_ids, own_at, own_sizes, counts)
        else:
            ids = _gathered(runs.ids, at, ids_of_each)
        ends = np.concatenate(([0], np.cumsum(ids_of_each)))[np.cumsum(sizes)].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _keys(texts: list[str], sizes: np.ndarray, seed: int) -> np.ndarray:
        """A key for each word, of seed, document and its place there."""
        from xxhash import xxh64_intdigest

        docs = np.fromiter((xxh64_intdigest(t.encode(), seed & (1 << 64) - 1) for t in texts), np.uint64, len(texts))
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            return _mixed(np.repeat(docs, sizes) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def _descend(self, runs: Runs, run: np.ndarray, keys: np.ndarray, rate: float) -> np.ndarray:
        """Lead each occurrence in run from its word's run without skips to its own one, or, where that isn't known, as near as can be.

        A missing run that several occurrences come by is made; those that come to one alone are given back.
        """
        todo, draw, alone = np.flatnonzero(run >= 0), 0, [np.zeros(0, np.int64)]
        at = np.full(len(todo), -1)
        while len(todo):
            at = at + 1 + passed(keys[todo], draw, rate)
            on = at < runs.count[run[todo]]
            todo, at = todo[on], at[on]
            way = runs.ways_at[run[todo]] + at
            missing = np.flatnonzero(runs.ways[way] < 0)
            new, first, times = np.unique(way[missing], return_index=True, return_counts=True)
            new, first = new[times > 1], missing[first[times > 1]]
            if len(new):
                parents = run[todo[first]].tolist()
                words, skips = [runs.word_of[n] for n in parents], [(*runs.skips[n], k) for n, k in zip(parents, at[first].tolist(), strict=True)]
                numbers = runs.add(words, skips, *self.segment(words, *_packed(skips)))
                runs.ways[new] = numbers
            on = runs.ways[way] >= 0
            alone.append(todo[~on])
            todo, at, way = todo[on], at[on], way[on]
            run[todo] = runs.ways[way]
            draw += 1
        return np.concatenate(alone)

    @staticmethod
    def _keep(runs: Runs, parents: np.ndarray, words: list[str], skips: np.ndarray, n_skips: np.ndarray, ids: np.ndarray, at: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
        """Remember, of runs that occurrences made for themselves, those that are one skip away from a remembered one."""
        n = np.flatnonzero(parents >= 0)
        first, k = (np.cumsum(n_skips) - n_skips)[n], runs.depth[parents[n]]
        end = k + 1 == n_skips[n]
        one = end | (skips[np.where(end, 0, first + k + 1)] >= counts[n]) if len(n) else end
        n, first, k = n[one], first[one], k[one]
        way, kept = np.unique(runs.ways_at[parents[n]] + skips[first + k], return_index=True)
        if len(way):
            n, first, k = n[kept], first[kept], k[kept]
            own_skips = [tuple(skips[a:b].tolist()) for a, b in zip(first.tolist(), (first + k + 1).tolist(), strict=True)]
            runs.ways[way] = runs.add([words[x] for x in n.tolist()], own_skips, _gathered(ids, at[n], sizes[n]), sizes[n], counts[n])

    @staticmethod
    def _skips(keys: np.ndarray, words: list[str], rate: float) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of each occurrence's skipped candidates, one occurrence after another, and how many they are; a word has fewer
        than three for each character."""
        bound = 3 * np.fromiter(map(len, words), np.int64, len(words)) + 3
        todo, at, draw, rows, skipped = np.arange(len(words)), np.full(len(words), -1), 0, [], []
        while len(todo):
            at = at + 1 + passed(keys[todo], draw, rate)
            on = at < bound[todo]
            todo, at = todo[on], at[on]
            rows.append(todo)
            skipped.append(at)
            draw += 1
        rows, skipped = np.concatenate(rows), np.concatenate(skipped)
        return skipped[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(words))

    def _forms(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The characters to merge of all words, where each one's begin and how many they are: BLANK is a blank, SIGN a blank sign of the text."""
        chars = np.frombuffer((BLANK + BLANK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(lengths) - lengths
        first = chars[np.minimum(starts + 1, len(chars) - 1)]
        whole = (lengths > 1) & ((first == ord(MARK)) | (self.by_lines & (first == ord("\n"))))  # they have the blanks before them, or none
        chars[chars == ord(MARK)] = ord(BLANK)
        return chars, starts + whole, lengths - whole

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def _text(chars: np.ndarray) -> str:
    return chars.tobytes().decode("utf-32-le", "surrogatepass")


@cache
def pieces(path: str) -> Pieces:
    """One for each worker process."""
    return Pieces(path)


def encode_pieces(docs: DataFrame, model: str, seed: int = 1, rate: float = 0.1) -> DataFrame:
    """docs with ``ids`` (array of int), n_pieces and lossless (the ids decode to the very text).

    Null and empty texts have no ids and are lossless. Texts are encoded whole. Other columns pass through, those of these
    names are replaced; repeated rows have equal ids.
    """
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())]
    names = {f.name for f in added}
    kept = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            whole = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            for first, texts in runs_of(whole, CHUNK_CHARS):
                ids = own.encode(texts, seed, rate)
                fine = [own.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
                rows = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(f.name)) for f in kept), lists, pa.array(sizes), pa.array(fine)], names=[*(f.name for f in kept), "ids", "n_pieces", "lossless"])
        own.memo = Runs()  # a worker lives on after its task, and so would all that it remembers

    return small_batches(docs).select(*(f.name for f in kept)).mapInArrow(run, T.StructType(kept + added))


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """encoded(ids, ...) with ``text`` restored from the ids; null ids give null."""
    kept = [f for f in encoded.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            texts = [None if i is None else own.decode(np.array(i, np.int64)) for i in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "text"])

    return encoded.select(*(f.name for f in kept)).mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids, comma-joined) and lossless of every document."""
    found = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
    return found.select("doc_id", "n_pieces", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "lossless")
