"""Brute-force versions of the operators, and dirty tables for them."""

from __future__ import annotations

import random
import re
import unicodedata as ud


def words(text):
    return [w.lower() for w in re.findall("[a-zA-Z0-9]+", text or "")]


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def families(seed=1, bases=12, length=150):
    """Texts in groups of small edits, with unrelated ones between them."""
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        base = prose(rng, length)
        out += [base, edited(rng, base, 2), edited(rng, base, 5), edited(rng, base, 40)]
    rng.shuffle(out)
    return out


def folded_line(line):
    return " ".join(line.split()).lower()


ALIKE = dict(zip("аАВсСԁеЕһНіІјЈКӏМоОрРԛѕЅТԝхХуУΑΒΕΗΙΚΜΝοΟΡΤΧΥΖɡνıոսօ", "aABcCdeEhHiIjJKlMoOpPqsSTwxXyYABEHIKMNoOPTXYZgvinuo"))


def look(text):
    out = []
    for c in ud.normalize("NFD", text):
        d = ud.decomposition(c)
        if c in ALIKE:
            c = ALIKE[c]
        elif d.startswith(("<wide>", "<narrow>")) or "ﬀ" <= c <= "ﬆ":
            c = ud.normalize("NFKC", c)
        elif ud.category(c) == "Cf":
            c = ""
        elif ud.category(c) == "Zs":
            c = " "
        out.append(c)
    return ud.normalize("NFD", "".join(out))
