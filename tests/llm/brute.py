"""Plain versions of the operators for small inputs."""

import itertools
import re

import numpy as np

from terraledger.llm import substring, words


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(texts):
    """{number: smallest number that links reach}."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def word_mark(word):
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(words.words(raw, np.array([0, len(raw)])).marks[0])


def cut_after(word, gap):
    return word[-1] in ".!?" or "\n" in gap or (word_mark(word) >> 17) % substring.EVERY == 0


def text_pieces(text):
    """[(piece, its words in lower case)]; a piece ends where the word before the blanks says so."""
    found = list(re.finditer(r"[^ \t\n\v\f\r]+", text))
    out, start, own = [], 0, []
    for k, m in enumerate(found):
        own.append("".join(c.lower() if c.isascii() else c for c in m.group()))
        end = found[k + 1].start() if k + 1 < len(found) else len(text)
        if k + 1 == len(found) or cut_after(m.group(), text[m.end() : end]):
            out.append((text[start:end], own))
            start, own = end, []
    return out or ([(text, [])] if text else [])


def stripped(texts, least, min_words):
    """Texts without the pieces that a repeated run, its first occurrence excepted, covers; every run of every length is tried."""
    cut = [text_pieces(t) for t in texts]
    where = {}
    for d, ps in enumerate(cut):
        for i in range(len(ps)):
            run = []
            for j in range(i, len(ps)):
                run += ps[j][1]
                if j - i + 1 >= least and len(run) >= min_words:
                    where.setdefault(tuple(run), []).append((d, i, j))
    gone = [set() for _ in texts]
    for places in where.values():
        for d, i, j in sorted(places)[1:]:
            gone[d].update(range(i, j + 1))
    return ["".join(p for k, (p, _) in enumerate(ps) if k not in gone[d]) for d, ps in enumerate(cut)], [len(g) for g in gone]
