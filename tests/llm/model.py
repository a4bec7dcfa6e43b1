"""Plain-Python models of the operators, and documents that are hard on them."""

import hashlib
import random
import re

SPACE = rb"[^\x20\x09-\x0D]+"
ALNUM = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket long, kind int, copy int, n long, sig long, row string"


def words(text, pattern):
    return re.findall(pattern, (text or "").encode().translate(LOWER))


def corpus(seed=3):
    """(doc_id, text): prose, exact and near copies, shared passages, a hot group,
    a very long text, runs of one byte, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéöñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",\n", ". "]) for _ in range(n))

    texts = [prose(rng.randint(1, 200)) for _ in range(60)]
    passage = prose(70)
    texts += [f"{prose(20)}\n{passage}\n{prose(rng.randint(5, 60))}" for _ in range(12)]
    base = prose(150).split(" ")
    for _ in range(25):  # a chain of near copies
        base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append(" ".join(base))
    texts += [texts[5]] * 20 + [texts[7].upper(), texts[7].replace(" ", "  \t")]
    texts += ["", None, " \n\t", "a", "b c", "B  C", "x" * 700, "xy" * 400, "é" * 120, "a\0 b", prose(6000), "\x85\xa0 q"]
    return [(i * 7 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """Documents with columns that clash with inner names."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5, "r") for i, t in rows], SCHEMA)


def components(rows, size=5, percent=75):
    sets = {}
    for i, t in rows:
        w = words(t, SPACE)
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            piece = b[p : p + length]
            if piece in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def contamination(rows, items, size=10):
    sought = []
    for item, text in items:
        w = words(text, ALNUM)
        n = min(size, len(w))
        sought += [(item, tuple(w[k : k + n])) for k in range(len(w) - n + 1 if n else 0)]
    out = {}
    for i, t in rows:
        w = words(t, ALNUM)
        hit, found = set(), set()
        for item, window in sought:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found.add(item)
        out[i] = (len(w), len(hit), sorted(found))
    return out


def without_spans(rows, span=3):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        sentences, own, begin, end = [], [], None, None
        for m in re.finditer(SPACE, b):
            if own and (b[end - 1 : end] in (b".", b"!", b"?") or b"\n" in b[end : m.start()]):
                sentences.append((begin, tuple(own)))
                own = []
            if not own:
                begin = m.start()
            own.append(m.group().translate(LOWER))
            end = m.end()
        if own:
            sentences.append((begin, tuple(own)))
        n = len(sentences)
        length, gone = min(span, n), [False] * n
        for k in range(n - length + 1 if n else 0):
            key = tuple(w for _, w in sentences[k : k + length])
            if key in seen:
                gone[k : k + length] = [True] * length
            seen.add(key)
        kept = b[: sentences[0][0]] if n else b
        for k in range(n):
            if not gone[k]:
                kept += b[sentences[k][0] : sentences[k + 1][0] if k + 1 < n else len(b)]
        out[i] = (n, sum(gone), kept)
    return out
