"""Helpers that run inside Arrow-batched UDFs: Porter's suffix stripping (1980)
with the usual later extensions, the length of the longest common subsequence
by bit vectors (Crochemore et al., 2001), and clipped gram matches."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

# Suffix tables of the published algorithm.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing",
    "canning": "canning", "cannings": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]


_SHAPE = bytes(ord("v" if chr(c) in "aeiou" else "c") for c in range(256))


def _shape(word: str) -> str:
    """The word as ``c``/``v`` letters; ``y`` after a consonant is a vowel."""
    if "y" not in word and word.isascii():
        return word.encode().translate(_SHAPE).decode()
    out: list[str] = []
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Consonant-vowel-consonant end, or a two-letter vowel-consonant word."""
    shape = _shape(stem)
    return (shape.endswith("cvc") and stem[-1] not in "wxy") or shape == "vc"


def _longest_first(rules) -> dict[str, list[tuple[str, str]]]:
    """By last letter."""
    ordered = sorted(rules, key=lambda rule: -len(rule[0]))
    return {last: [rule for rule in ordered if rule[0][-1] == last] for last in {rule[0][-1] for rule in ordered}}


STEP2, STEP3 = _longest_first(STEP2), _longest_first(STEP3)
STEP4 = _longest_first([(end, "") for end in STEP4])


#: Last letters of words that some rule may change.
CHANGING = frozenset("sdgy").union(STEP2, STEP3, STEP4, "el")


def _longest(word: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str, str] | None:
    for end, new in rules.get(word[-1:], ()):
        if word.endswith(end):
            return word[: len(word) - len(end)], end, new
    return None


@lru_cache(maxsize=200_000)
def porter_stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2 or word[-1] not in CHANGING:
        return word
    # plurals
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past tense and gerund
    if word[-1:] not in ("d", "g"):
        pass
    elif word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            stem = word[: len(word) - len(end)]
            if word.endswith(end) and "v" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    word = stem + "e"
                elif _shape(stem)[-2:] == "cc" and stem[-2:-1] == stem[-1] and stem[-1] not in "lsz":
                    word = stem[:-1]
                elif _measure(stem) == 1 and _short_end(stem):
                    word = stem + "e"
                else:
                    word = stem
                break
    # final y
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    # double suffixes
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    if word.endswith("logi") and _measure(word[:-3]) > 0:
        word = word[:-1]
    else:
        hit = _longest(word, STEP2)
        if hit and _measure(hit[0]) > 0:
            word = hit[0] + hit[2]
    hit = _longest(word, STEP3)
    if hit and _measure(hit[0]) > 0:
        word = hit[0] + hit[2]
    hit = _longest(word, STEP4)
    if hit and _measure(hit[0]) > 1 and (hit[1] != "ion" or hit[0][-1] in "st"):
        word = hit[0]
    # final e and double l
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


#: Positions of the longer list that one pass over the shorter one takes: a
#: token's places in it are a number of so many bits.
LCS_BLOCK = 8192


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence: one word-parallel row update per token and
    block of the longer list; a block hands the carries of its updates on to the
    next, so memory does not grow with the square of the lists."""
    shared = set(a) & set(b)
    a, b = sorted(([t for t in a if t in shared], [t for t in b if t in shared]), key=len)
    carries, found = bytes(len(a)), 0
    for low in range(0, len(b), LCS_BLOCK):
        part = b[low:low + LCS_BLOCK]
        size = len(part)
        where: dict[str, int] = {}
        for i, token in enumerate(part):
            where[token] = where.get(token, 0) | (1 << i)
        row = full = (1 << size) - 1
        out = bytearray(len(a))
        for j, token in enumerate(a):
            hit, carry = row & where.get(token, 0), carries[j]
            if hit or carry:
                total = row + hit + carry
                out[j] = total >> size
                row = (total | (row - hit)) & full
        carries = out
        found += size - row.bit_count()
    return found


# Any other byte ends a word of ROUGE; line feeds stand between tokens.
_WORD = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789\n" else 32 for c in range(256))
#: Characters of text that are numbered at once (or one longer pair), and tokens that keep their words from text to text.
BLOCK, KEPT_WORDS = 1 << 21, 500_000


class Words:
    """Tokens of texts as numbers: white-space tokens, and lower-case runs of
    ASCII letters and digits, stemmed where they are longer than three.  A
    distinct token of a block is cut once, and stemmed when it is first seen."""

    def __init__(self, stem: bool):
        self.stem = stem
        self.words: dict[bytes, int] = {}  # of one run; of others, where they are in ``several``
        self.several: list[list[int]] = []
        self.stems: dict[str, int] = {}

    def _stem(self, word: bytes) -> int:
        text = word.decode()
        stem = porter_stem.__wrapped__(text) if self.stem and len(text) > 3 else text
        return self.stems.setdefault(stem, len(self.stems))

    def _cut(self, token: bytes) -> int:
        if token.isalnum():
            number = self._stem(token)
        else:
            found = list(map(self._stem, token.split()))
            if len(found) == 1:
                number = found[0]
            else:
                self.several.append(found)
                number = -len(self.several)
        self.words[token] = number
        return number

    def numbers(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Tokens of each text, and its words; numbers hold for these texts."""
        if len(self.words) > KEPT_WORDS:
            self.__init__(self.stem)
        tokens = [text.split() for text in texts]
        ends = np.append(0, np.cumsum(list(map(len, tokens))))
        flat = list(chain.from_iterable(tokens))
        distinct = dict.fromkeys(flat)
        index = dict(zip(distinct, range(len(distinct))))
        token = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        cut = "\n".join(distinct).lower().encode().translate(_WORD)
        cut = cut.replace(b" \n", b"\n").replace(b"\n ", b"\n").split(b"\n") if distinct else []
        known = list(map(self.words.get, cut))
        known = np.array([self._cut(c) if n is None else n for n, c in zip(known, cut)], np.int64)
        several = np.flatnonzero(known < 0)
        lists = [self.several[-1 - n] for n in known[several].tolist()]
        count, first = np.ones(len(known), np.int64), np.arange(len(known))
        count[several] = list(map(len, lists))
        first[several] = len(known) + np.cumsum(count[several]) - count[several]
        words = np.append(known, np.array([n for found in lists for n in found], np.int64))
        count, first = count[token], first[token]
        upto = np.append(0, np.cumsum(count))
        word = words[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])]
        cuts = ends[1:-1]
        return np.split(token, cuts), np.split(word, upto[cuts])

    def shared(self, generated: np.ndarray, reference: np.ndarray) -> int:
        """Length of the longest common subsequence of two texts' words."""
        mark, both = np.zeros(len(self.stems), bool), []
        for side, other in ((generated, reference), (reference, generated)):
            mark[other] = True
            both.append(side[mark[side]].tolist())
            mark[other] = False
        return lcs_length(*both)

    def pairs(self, texts: Iterable[tuple[str, str]]) -> Iterator[tuple[tuple[int, int, int], list[np.ndarray]]]:
        """For every pair of texts the length of the subsequence and how many
        words either has, and both sides' tokens."""
        held, size = [], 0
        for pair in chain(texts, [None]):
            added = sum(map(len, pair)) if pair else 0
            if held and (pair is None or size + added > BLOCK):
                tokens, found = self.numbers(held)
                for i in range(0, len(held), 2):
                    g, r = found[i:i + 2]
                    yield (self.shared(g, r), len(g), len(r)), tokens[i:i + 2]
                held, size = [], 0
            held += pair or ()
            size += added


@lru_cache
def worker_words(stem: bool) -> Words:
    """The tokens that a worker keeps from task to task."""
    return Words(stem)


#: Tokens whose grams are counted at once; a longer pair is counted alone.
GRAM_TOKENS = 1 << 14


def gram_matches(pairs: Iterable[tuple[list[str] | np.ndarray, list[str] | np.ndarray]], order: int) -> Iterator[np.ndarray]:
    """Sizes of both token lists of each pair and, for n = 1..order, the grams
    of length n in both, each counted as often as in the rarer: arrays of one
    row per pair, for a bounded number of tokens at a time.  Tokens may be
    numbers that are the pair's own."""
    held, size = [], 0
    for pair in pairs:
        added = len(pair[0]) + len(pair[1])
        if held and size + added > GRAM_TOKENS:
            yield _clipped(held, order)
            held, size = [], 0
        known: dict[str, int] = {}
        held += [side if isinstance(side, np.ndarray) else np.fromiter((known.setdefault(t, len(known)) for t in side), "int64", len(side)) for side in pair]
        size += added
    if held:
        yield _clipped(held, order)


def _clipped(sides: list[np.ndarray], order: int) -> np.ndarray:
    sizes = np.fromiter(map(len, sides), "int64", len(sides))
    out = np.zeros((len(sides) // 2, 2 + order), "int64")
    out[:, :2] = sizes.reshape(-1, 2)
    token = np.concatenate(sides)
    n_names = int(token.max(initial=0)) + 1
    side = np.repeat(np.arange(len(sides)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(token))  # tokens from here to the end of the side
    # a gram is the number of its first tokens among the grams of its pair that both sides hold, and its last token:
    # one that a side lacks cannot begin or end a longer one that both hold
    here, key, pair = np.arange(len(token)), (side >> 1) * n_names + token, np.arange(len(sides) // 2)
    for n in range(1, order + 1):
        if not len(key):
            break
        both = np.sort(key * 2 + (side[here] & 1))
        first = np.flatnonzero(np.diff(both >> 1, prepend=-1))
        reference = np.add.reduceat(both & 1, first)
        clipped = np.minimum(reference, np.diff(first, append=len(both)) - reference)
        known, clipped = both[first[clipped > 0]] >> 1, clipped[clipped > 0]
        if not len(known):
            break
        pair = pair[known // n_names]
        out[:, 1 + n] = np.bincount(pair, clipped, len(sides) // 2)
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        number = np.full(len(token) + 1, -1)
        number[here] = np.where(known[place] == key, place, -1)
        here = here[(number[here] >= 0) & (left[here] > n) & (number[here + 1] >= 0)]
        key = number[here] * n_names + token[np.minimum(here + n, len(token) - 1)]
    return out


def clipped_matches(generated: list[str], reference: list[str], n: int) -> int:
    """Grams of length n in both lists, each counted as often as in the rarer."""
    return int(next(gram_matches([(generated, reference)], n))[0, 1 + n])
