"""Slow, plain versions of the operators' rules, and rows that try their edges."""
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words_of(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def groups(sets):
    """Smallest index reachable by links, for each set."""
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def random_words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def near_copies(seed=1, families=6, members=12):
    """Families of texts at all distances around the threshold, with shared passages."""
    rng = random.Random(seed)
    passage = random_words(rng, 40)
    out = []
    for _ in range(families):
        base = random_words(rng, rng.randrange(8, 150))
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(["Q", "ß", "x"])
            if rng.random() < 0.3:
                w += passage
            out.append(rng.choice([" ", "\n", " \t "]).join(w))
    rng.shuffle(out)
    return out


EDGES = [None, "", " \t\n", "one", "One", "a b c d", "A b c\td", "a b c d e", "x " * 3000, "long " + "y z " * 20000,
         "  nbsp joins", "émigré 🎈 \x00 nul"]
