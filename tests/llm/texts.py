"""Small corpora and plain re-statements of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def sentences(rng, n):
    return "\n".join(prose(rng, 12).capitalize() + "." for _ in range(n))


def corpus(seed=3):
    """Copies, near copies, shared passages, short, empty, null and long texts, repeated rows, null ids."""
    rng = random.Random(seed)
    texts = [sentences(rng, rng.randint(5, 14)) for _ in range(30)]
    texts += [texts[0]] * 4 + [texts[1]] * 2
    for i in (2, 2, 2, 3):
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = prose(rng, 60)
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(3)]
    texts += ["", None, "one", "one two", "one", "same same " * 60, prose(rng, 9000)]
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[6], None, None, None), (None, None, None, None, None)]


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)])


def classes(rows, threshold=0.8):
    """(links, component) of each row by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    links, part = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                part[max(root(i), root(j))] = min(root(i), root(j))
    return links, [root(i) for i in range(len(rows))]
