"""The dynamic programme of prefix_bpe over many words at once, in numpy (used by operator 5).

Two tokens are the encoding of their own string if no merge across their border comes before the merges that made what
stands beside it: both are taken apart from the border on, the later made one first, and each two parts that meet there are
looked up. So a token that ends at a byte is tested in a few steps, for all words that are as long, and each byte's last
token follows from those before. Strings of tokens are compared by 64-bit hashes.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from newsloom.llm import textnum as T
from newsloom.llm.prefix_bpe import PrefixCounter

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # a split into runs of letters, single numbers, other runs
LETTER, NUMBER, OTHER, HARD = 1, 2, 3, 9
LONGEST = 200  # characters of words that are counted together
NEVER = np.iinfo(np.int32).max


class _Table:
    """int32 columns by 64-bit keys that are not 0; -1 where there is none."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.columns = [np.full(1 << self.bits, -1, np.int32) for _ in columns]
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            at, which = np.unique(slot[free], return_index=True)
            self.keys[at] = keys[free[which]]
            for own, column in zip(self.columns, columns, strict=True):
                own[at] = column[free[which]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        slot = self._slot(keys)
        found = self.keys[slot]
        other = np.flatnonzero((found != keys) & (found != 0))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.keys) - 1)
            again = self.keys[slot[other]]
            other = other[(again != keys[other]) & (again != 0)]
        return [column[slot] for column in self.columns]  # where nothing is, -1 is


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BatchCounter:
    """Counts at the prefixes of words, equal to those of the PrefixCounter, which counts words of unusual characters."""

    def __init__(self, counter: PrefixCounter) -> None:
        self.one = counter
        made = {a + b: (a, b, k) for (a, b), k in counter.rank.items()}
        born = lambda t: made[t][2] if t in made else -1
        # merges that make what they name once, and from tokens that were made before
        self.usable = counter.pattern == PATTERN and len(made) == len(counter.rank) and all(born(a) < k > born(b) for a, b, k in made.values())
        if self.usable:
            self._read(made)

    def _read(self, made: dict) -> None:
        end, byte = self.one.end, _byte_of()
        names = [t for t in self.one.vocab if len(self.one._symbols(t)) == 1 or t in made]
        marked = np.array([bool(end) and t.endswith(end) and t != end for t in names])
        bodies = [t[: -len(end)] if m else t for t, m in zip(names, marked, strict=True)]
        known = np.array([set(t) <= byte.keys() for t in bodies])
        place = {t: k for k, t in enumerate(names)}
        parts = np.array([made[t] if t in made else ("", "", -1) for t in names], object)
        self.rank = parts[:, 2].astype(np.int32)
        self.left = np.array([place.get(t, 0) for t in parts[:, 0]], np.int32)
        self.right = np.array([place.get(t, 0) for t in parts[:, 1]], np.int32)
        self.n = np.uint64(len(names))
        grown = np.flatnonzero(self.rank >= 0)
        self.pairs = _Table(self._pair(self.left[grown], self.right[grown]), self.rank[grown])
        held = np.ones(len(names), bool)
        held[grown] = self._fit(self.left[grown], self.right[grown], self.rank[grown])
        for k in grown[np.argsort(self.rank[grown])].tolist():
            held[k] = held[k] and held[self.left[k]] and held[self.right[k]]
        rows = np.flatnonzero(held & known)
        raw = [bytes(byte[c] for c in bodies[k]) for k in rows]
        bounds = np.cumsum([0, *map(len, raw)])
        keys = self._hashes(np.frombuffer(b"".join(raw), np.uint8))(bounds[:-1], bounds[1:])
        key, where = np.unique(keys, return_inverse=True)
        both = np.full((2, len(key)), -1, np.int32)
        both[marked[rows].astype(int) if end else np.zeros(len(rows), int), where] = rows
        if not end:
            both[1] = both[0]
        self.tokens = _Table(key, both[0], both[1])
        self.longest = max(map(len, raw))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) * self.n + b.astype(np.uint64) + np.uint64(1)

    @staticmethod
    def _hashes(buf: np.ndarray):
        power, inverse = T._grown(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(T._BYTE[buf] * power[: len(buf)], out=total[1:])
        return lambda a, b: (total[b] - total[a]) * inverse[a]

    def _fit(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int) -> np.ndarray:
        """Whether no merge before until goes across the border of tokens a and b."""
        good, at = np.ones(len(a), bool), np.arange(len(a))
        until_a = np.full(len(a), until, np.int32)
        until_b = until_a.copy()
        while len(at):
            rank = self.pairs.find(self._pair(a, b))[0]
            bad = (rank >= 0) & (rank < until_a) & (rank <= until_b)
            good[at[bad]] = False
            of_a, of_b = self.rank[a], self.rank[b]
            on = np.flatnonzero(~bad & (np.maximum(of_a, of_b) >= 0))
            at, a, b, of_a, of_b, until_a, until_b = (x[on] for x in (at, a, b, of_a, of_b, until_a, until_b))
            later = of_a > of_b
            until_a, until_b = np.where(later, of_a, until_a), np.where(later, until_b, of_b)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return good

    def _ended(self, hashes, n_bytes: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each prefix of the pieces at starts, at the place of its last byte; pieces in order of falling size."""
        last, count, ended = np.full(n_bytes, -1, np.int32), np.zeros(n_bytes, np.int32), np.zeros(n_bytes, np.int32)
        for depth in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            end = starts[: np.searchsorted(-sizes, -depth, "right")] + depth
            need = np.ones((2, len(end)), bool)  # without a token so far: as a beginning, as a whole piece
            for size in range(min(depth, self.longest), 0, -1):
                some = np.flatnonzero(need.any(0))
                if not len(some):
                    break
                begin = end[some] - size
                hit = np.stack(self.tokens.find(hashes(begin, end[some])))
                ok = (hit >= 0) & need[:, some]
                if size < depth:
                    ok &= last[begin - 1] >= 0
                kind, piece = np.nonzero(ok)
                if not len(piece):
                    continue
                token, n = hit[kind, piece], np.ones(len(piece), np.int32)
                if size < depth:
                    fits = self._fit(last[begin[piece] - 1], token, NEVER)
                    kind, piece, token = kind[fits], piece[fits], token[fits]
                    n = count[begin[piece] - 1] + 1
                at, beginning = end[some[piece]] - 1, kind == 0
                last[at[beginning]], count[at[beginning]], ended[at[~beginning]] = token[beginning], n[beginning], n[~beginning]
                need[kind, some[piece]] = False
        return ended

    @lru_cache(maxsize=65536)  # noqa: B019  one counter for each worker and file
    def _char(self, char: str) -> tuple[int, int]:
        """(kind, normal form) of a character, as the library tells them; HARD where it takes the characters beside it."""
        normal = self.one.normal(char)
        if len(normal) != 1 or unicodedata.category(char)[0] == "M" or "ᅠ" <= char <= "ᇿ" or char in self.one.firsts:
            return HARD, 0
        pieces = [len(self.one.split(x)) for x in ("a" + normal, "!" + normal, normal, normal + normal)]
        kind = {(1, 2, 1, 1): LETTER, (2, 1, 1, 1): OTHER, (2, 2, 1, 2): NUMBER}.get(tuple(pieces), HARD)
        return kind, ord(normal)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(characters of each word, counts at the ends of all their characters in order)."""
        text = b"\n".join(words).decode()
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        word = np.cumsum(chars == 10)
        word, chars = word[chars != 10], chars[chars != 10]
        sizes = np.bincount(word, minlength=len(words))
        hard = sizes > LONGEST
        if self.usable:
            distinct, which = np.unique(chars, return_inverse=True)
            told = np.array([self._char(chr(c)) for c in distinct], np.int64).reshape(-1, 2)
            kind, normal = told[which, 0], told[which, 1]
            hard |= np.bincount(word, kind == HARD, len(words)) > 0
        else:
            hard[:] = True
        out = np.zeros(len(chars), np.int32)
        begins = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(hard).tolist():
            out[begins[k] : begins[k] + sizes[k]] = self.one.word(words[k].decode())
        if not hard.all():
            easy = ~hard[word]
            out[easy] = self._runs(word[easy], kind[easy], normal[easy].astype(np.uint32))
        return sizes, out

    def _runs(self, word: np.ndarray, kind: np.ndarray, normal: np.ndarray) -> np.ndarray:
        """Counts at each character of words in which runs of one kind are pieces, numbers each for itself."""
        buf = np.frombuffer(normal.tobytes().decode("utf-32-le").encode(), np.uint8)
        end = np.cumsum(1 + (normal > 0x7F) + (normal > 0x7FF) + (normal > 0xFFFF))
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        first = np.flatnonzero(new)
        start = np.where(first > 0, end[first - 1], 0)
        stop = np.append(start[1:], len(buf))
        hashes = self._hashes(buf)
        _, own, same = np.unique(hashes(start, stop), return_index=True, return_inverse=True)
        order = np.argsort(-(stop - start)[own], kind="stable")
        ended = self._ended(hashes, len(buf), start[own][order], (stop - start)[own][order])
        total = ended[stop[own][same] - 1]
        before = np.cumsum(total) - total
        head = np.flatnonzero(np.append(True, word[first][1:] != word[first][:-1]))
        before -= np.repeat(before[head], np.diff(np.append(head, len(first))))
        piece = np.cumsum(new) - 1
        return before[piece] + ended[start[own][same][piece] + end - start[piece] - 1]
