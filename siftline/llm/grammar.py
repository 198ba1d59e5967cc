"""Re-Pair grammars over sequences of token ids, and decoding from any place.

Adjacent pairs are counted; pairs that occur ``least`` times or more become rules, and
their occurrences are replaced by the new symbols, until no pair is frequent or a
round shortens the sequence by less than ``gain``.  One round takes all frequent pairs
at once: where two occurrences overlap the pair with the larger count wins, so the most
frequent pair is always replaced as a whole.  Symbols never reach over the end of a
document.

Symbols below ``vocabulary`` are ids, symbol vocabulary + i is rule i.  With each rule
the number of ids it expands to is stored, so the symbols that cover any stretch of ids
are found by a search in running sums, and only these are expanded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLOTS = 17  # bits of the table that finds the rule of a pair
SPREAD = 0x9E3779B97F4A7C15


@dataclass
class Grammar:
    vocabulary: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # ids that each rule expands to
    symbols: np.ndarray
    ends: np.ndarray  # True for the last symbol of a document

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """Number of ids of each symbol."""
        out = np.ones(len(symbols), np.int64)
        rules = symbols >= self.vocabulary
        out[rules] = self.length[symbols[rules] - self.vocabulary]
        return out


def _frequent(keys: np.ndarray, least: int) -> np.ndarray:
    """The keys that occur ``least`` times or more, most frequent first."""
    ordered = np.sort(keys)
    ordered = ordered[: len(ordered) - least + 1][ordered[: len(ordered) - least + 1] == ordered[least - 1 :]]  # each with least - 1 after it
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(ordered)))
    return ordered[first[np.lexsort((first, -counts))]]


def _ranks(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The place of each key in ``found``, or its length; of two found keys in one slot the first is known.

    The other one is found again in a later round, when the first one is gone.
    """
    kind, bits = keys.dtype.type, 8 * keys.dtype.itemsize
    spread, shift = kind(SPREAD >> (64 - bits) | 1), kind(bits - SLOTS)
    table = np.zeros(1 << SLOTS, np.int32)
    table[((found * spread) >> shift)[::-1]] = np.arange(len(found), dtype=np.int32)[::-1]
    ranks = table[(keys * spread) >> shift]
    return np.where(found[ranks] == keys, ranks, np.int32(len(found)))


def _taken(ranks: np.ndarray, none: int) -> np.ndarray:
    """Places whose pair is replaced: none of the pairs that overlap it has a lower rank.

    ``ranks`` has a place for each symbol.  A run of one symbol holds equal pairs side
    by side, of which every other one is taken.
    """
    taken = ranks < none
    taken[1:] &= ranks[1:] <= ranks[:-1]
    taken[:-1] &= ranks[:-1] <= ranks[1:]
    places = np.flatnonzero(taken)
    beside = np.append(False, np.diff(places) == 1)  # only pairs of equal rank are taken side by side
    if beside.any():
        index = np.arange(len(places))
        begin = np.maximum.accumulate(np.where(beside, 0, index))
        places = places[(index - begin) % 2 == 0]
    return places


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, least: int = 8, gain: float = 0.02) -> Grammar:
    """The grammar of documents laid end to end; ``ends`` marks the last id of each."""
    symbols, ends, least = ids.astype(np.uint32), ends.astype(bool), max(least, 2)
    rules: list[tuple[np.ndarray, np.ndarray]] = []
    lengths = np.ones(0, np.int64)
    while len(symbols) > least:
        if vocabulary + len(lengths) <= 1 << 16:
            half, keys = 16, (symbols[:-1] << np.uint32(16)) | symbols[1:]
        else:
            half, keys = 32, (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        inner = ~ends[:-1]
        found = _frequent(keys[inner], least)
        if not len(found):
            break
        ranks = np.append(np.where(inner, _ranks(keys, found), np.int32(len(found))), np.int32(len(found)))
        taken = _taken(ranks, len(found))
        worth = np.bincount(ranks[taken], minlength=len(found)) >= least
        taken = taken[worth[ranks[taken]]]
        if not len(taken) or len(taken) < gain * len(symbols):
            break
        number = np.cumsum(worth) - 1 + vocabulary + len(lengths)
        left, right = np.divmod(found[worth].astype(np.int64) if half == 16 else found[worth], 1 << half)
        left, right = left.astype(np.int64), right.astype(np.int64)
        sizes = np.append(np.ones(vocabulary, np.int64), lengths)
        rules.append((left, right))
        lengths = np.append(lengths, sizes[left] + sizes[right])
        symbols[taken] = number[ranks[taken]]
        ends[taken] = ends[taken + 1]
        kept = np.ones(len(symbols), bool)
        kept[taken + 1] = False
        symbols, ends = symbols[kept], ends[kept]
    left, right = (np.concatenate([r[i] for r in rules]) if rules else np.zeros(0, np.int64) for i in (0, 1))
    return Grammar(vocabulary, left, right, lengths, symbols.astype(np.int64), ends)


def expand(grammar: Grammar, symbols: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for, one level of rules at a time."""
    sizes = grammar.expanded(symbols)
    out = np.zeros(int(sizes.sum()), np.int64)
    at = np.cumsum(sizes) - sizes
    while len(symbols):
        plain = symbols < grammar.vocabulary
        out[at[plain]] = symbols[plain]
        rules, at = symbols[~plain] - grammar.vocabulary, at[~plain]
        left, right = grammar.left[rules], grammar.right[rules]
        symbols = np.concatenate([left, right])
        at = np.concatenate([at, at + grammar.expanded(left)])
    return out


def ids_between(grammar: Grammar, first: int, past: int) -> np.ndarray:
    """Ids ``first`` to ``past`` (exclusive) of the whole sequence; only rules that cover them are expanded."""
    upto = np.cumsum(grammar.expanded(grammar.symbols))
    first, past = max(first, 0), min(past, int(upto[-1]) if len(upto) else 0)
    if first >= past:
        return np.zeros(0, np.int64)
    a, b = np.searchsorted(upto, [first, past - 1], "right")
    symbols = _without(grammar, grammar.symbols[a : b + 1], first - (int(upto[a - 1]) if a else 0))
    spare = int(grammar.expanded(symbols).sum()) - (past - first)
    return expand(grammar, _without(grammar, symbols[::-1], spare, back=True)[::-1])


def _without(grammar: Grammar, symbols: np.ndarray, skip: int, back: bool = False) -> np.ndarray:
    """Symbols without those of the first ``skip`` ids, by opening the rules on the way to that place.

    With ``back`` the symbols come last to first.
    """
    head, rest = [int(symbols[0])], symbols[1:]
    while skip:
        if not head:
            head, rest = [int(rest[0])], rest[1:]
        symbol = head.pop()
        size = int(grammar.length[symbol - grammar.vocabulary]) if symbol >= grammar.vocabulary else 1
        if size <= skip:
            skip -= size
            continue
        rule = symbol - grammar.vocabulary
        parts = int(grammar.left[rule]), int(grammar.right[rule])
        head += parts if back else parts[::-1]
    return np.concatenate([np.array(head[::-1], np.int64), rest])
