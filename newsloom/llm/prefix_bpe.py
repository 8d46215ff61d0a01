"""Exact token counts at every prefix of a word, by dynamic programming over the prefixes (used by operator 5).

A sequence of BPE tokens is the encoding of its string if and only if each two neighbours are the encoding of their own
string. So last[j], the last token of the first j symbols, is the one token t that ends at j and that fits behind
last[j - len(t)], and count[j] = count[j - len(t)] + 1. Words end with a mark of their own: ended[j] is the same step with
the token that carries the mark. Nothing is encoded again for another prefix, and the work grows with the word's length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import accumulate

FITTING = 500_000  # pairs of tokens that a worker remembers; all are forgotten when there are more

#: An alternative of a split pattern that matches no white space: a literal, or characters of a class.
_LITERAL = re.compile(r"[\w'’]+")
_CLASS = re.compile(r"\[(\\p\{[LNMPS][a-z]?\}|\^\\s(\\p\{[A-Z][a-z]?\})*)+\]\+?")
_LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}


def refusal(spec: dict) -> str | None:
    """Why a tokenizer file doesn't prove that a text's tokens are those of its words, or None.

    Read from the file: the normalizer maps characters next to white space as it does without; the split pattern drops
    white space and no match holds any; added tokens hold no white space and don't take any from beside them.
    """
    normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    for step in normal["normalizers"] if normal["type"] == "Sequence" else [normal]:
        blanks = step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "
        if step["type"] not in _LOCAL and not blanks:
            return f"normalizer {step['type']}"
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    if pre.get("type") != "Sequence" or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return "pre-tokenizer"
    split, level = steps
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return "pre-tokenizer's options"
    for part in split["pattern"].get("Regex", "(").split("|"):
        if not _LITERAL.fullmatch(part) and not _CLASS.fullmatch(part):
            return f"split pattern {part}"
    for token in spec.get("added_tokens", []):
        if re.search(r"\s", token["content"]) or any(token[k] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            return f"added token {token['content']}"
    model = spec["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or spec.get("post_processor"):
        return "model"
    return None


class PrefixCounter:
    """Token counts at the prefixes of words, for one tokenizer file that refusal() accepts."""

    def __init__(self, path: str, tokenizer) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        why = refusal(spec)
        if why:
            raise ValueError(f"tokens of a text may not be those of its words: {why}")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.vocab = frozenset(spec["model"]["vocab"])
        self.longest = max(map(len, self.vocab))
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        literals = [p for p in self.pattern.split("|") if _LITERAL.fullmatch(p)]
        self.literal = max(map(len, literals), default=0)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.firsts = {x[0] for x in (*literals, *added)}
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.normal = (lambda x: x) if tokenizer.normalizer is None else lru_cache(65536)(tokenizer.normalizer.normalize_str)
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.known: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _encoded(self, symbols: list[str]) -> list[str]:
        """The merges in their order, for the few symbols of one or two tokens."""
        while len(symbols) > 1:
            best, at = min((self.rank.get(p, len(self.rank)), k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == len(self.rank):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _fits(self, a: str, b: str) -> bool:
        """Whether b can follow a (at the start: a is empty)."""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > FITTING:
                self.known.clear()
            pair = [a, b] if a else [b]
            found = self.known[a, b] = self._encoded([s for t in pair for s in self._symbols(t)]) == pair
        return found

    def piece(self, symbols: str) -> list[int]:
        """Tokens of the first j symbols as a piece of its own, for j from 0 to all."""
        last, count, ended = [""], [0], [0]
        for j in range(1, len(symbols) + 1):
            token, n, stop = None, 0, 0
            for i in range(max(0, j - self.longest), j):
                part = symbols[i:j]
                if i and last[i] is None:
                    continue
                if token is None and part in self.vocab and self._fits(last[i], part):
                    token, n = part, count[i] + 1
                if not stop and part + self.end in self.vocab and self._fits(last[i], part + self.end):
                    stop = count[i] + 1
            last.append(token)
            count.append(n)
            ended.append(stop)
        return ended

    def _alone(self, normal: str) -> int:
        return sum(self.piece(symbols)[-1] for symbols, _ in self.split(normal))

    def _plain(self, text: str) -> list[int]:
        """Tokens of the prefixes of 0 to all characters of a text in which added tokens aren't looked for."""
        # marks and the later letters of a Hangul syllable can join what is before them, other characters can't
        starts = [k for k, c in enumerate(text) if k == 0 or not (unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ")]
        groups = [text[a:b] for a, b in zip(starts, [*starts, len(text)][1:], strict=True)] if text else []
        parts = [self.normal(g) for g in groups]
        normal = "".join(parts)
        pieces = self.split(normal)
        totals = [self.piece(symbols) for symbols, _ in pieces]
        before = [0, *accumulate(t[-1] for t in totals)]
        out, at, k = [0], 0, 0  # at: characters of normal so far; k: the piece that holds or follows them
        for group, part in zip(groups, parts, strict=True):
            for i in range(1, len(group)):  # cut inside a group: its last piece is another one
                first = k if k < len(pieces) and pieces[k][1][0] < at else max(0, k - 1)
                begin = pieces[first][1][0] if pieces and pieces[first][1][0] < at else at
                done = before[first] if begin < at else before[k]
                out.append(done + self._alone(normal[begin:at] + self.normal(group[:i])))
            at += len(part)
            while k < len(pieces) and pieces[k][1][1] <= at:
                k += 1
            inside = ""
            if k < len(pieces) and pieces[k][1][0] < at:
                inside = normal[pieces[k][1][0] : at]
            if not inside:
                more = 0
            elif pieces[k][1][1] - pieces[k][1][0] <= self.literal:  # it may be a literal, whose beginning is split otherwise
                more = self._alone(inside)
            else:
                more = totals[k][len(inside.encode())]
            out.append(before[k] + more)
        return out

    def word(self, text: str) -> list[int]:
        """Tokens of the prefixes of 1 to all characters of a word, as the library counts each prefix."""
        out, begin, base = [0], 0, 0
        for match in self.added.finditer(text):
            counts = self._plain(text[begin : match.end() - 1])
            out += [base + n for n in counts[1:]]
            base += counts[match.start() - begin] + 1
            out.append(base)
            begin = match.end()
        out += [base + n for n in self._plain(text[begin:])[1:]]
        return out[1:]
