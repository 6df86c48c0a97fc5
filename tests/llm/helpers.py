"""Fixtures and brute-force versions for the training-data operators."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, hub string, k string"


def documents(spark, rows):
    """rows (doc_id, text, source), with extra columns whose names clash with what operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, None, "k") for i, t, s in rows], SCHEMA).repartition(3)


def corpus(n=60, seed=4):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(2, 7))) for _ in range(300)]
    common = "This line is shared by many of the documents and is long enough"
    rows = [(1000, None, None), (1001, "", "b"), (1002, " \t\n", None), (1003, "one two", "a"), (1004, "One  TWO", "b"), (1005, "five words are here now", None)]
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(12, 120))]
        text = " ".join(words)
        if i % 4 == 0:
            text += "\n  " + common.upper() + " \nlast"
        rows.append((i, text, r.choice(["a", "b", None])))
        if i % 3 == 0:
            changed = words.copy()
            changed[r.randrange(len(changed))] = "changed"
            rows.append((200 + i, " ".join(changed), "a"))
        if i % 5 == 0:
            rows.append((400 + i, text.replace(" ", "  "), "b"))
    rows.append((rows[-1][0], rows[-1][1], rows[-1][2]))
    rows.append((None, rows[7][1], "a"))
    return rows


def bad_host(rows, n=60):
    """rows with a host of which most documents fail, and a few good ones."""
    r = random.Random(1)
    prose = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    return rows + [(5000 + i, prose() if i % 6 == 0 else "too short", "spam") for i in range(n)] + [(6000 + i, prose(), h) for h in ("c", "d", "e") for i in range(40)]


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# quality ----------------------------------------------------------------------------------------


def base_features(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
    cover = {j + d for j in range(len(words) - 4) if seen[tuple(words[j : j + 5])] > 1 for d in range(5)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def failures(text):
    n, _, symbols, _, repeated = base_features(text)
    return n < 10, 100 * repeated > 20 * n, 100 * symbols > 10 * n


def rejected_hosts(rows):
    hosts = defaultdict(list)
    for _, t, s in rows:
        hosts[s].append(failures(t))
    bad = set()
    for rule in range(3):
        n = {h: len(v) for h, v in hosts.items()}
        f = {h: sum(x[rule] for x in v) for h, v in hosts.items()}
        total = sum(n.values())
        mean = sum(f.values()) / total
        spread = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in n)
        room = total - sum(x * x for x in n.values()) / total - (len(n) - 1)
        beyond = (spread / (mean * (1 - mean)) - (len(n) - 1)) / room if 0 < mean < 1 and room > 0 else 0
        size = min(1e6, max(1.0, 1 / beyond - 1)) if beyond > 0 else 1e6
        limit = min(0.5, max(0.3, mean + 2 * math.sqrt(mean * (1 - mean) / (size + 1))))
        for h in n:
            rate = (f[h] + size * mean) / (n[h] + size)
            if rate - 2 * math.sqrt(rate * (1 - rate) / (n[h] + size + 1)) > limit:
                bad.add(h)
    return bad


def quality_stage(rows):
    bad = rejected_hosts(rows)
    return [x for x in rows if not any(failures(x[1])[:2]) and x[2] not in bad]


# lines ------------------------------------------------------------------------------------------


def line_key(x):
    return ascii_lower(x.strip(" \t\n\x0b\x0c\r"))


def line_stage(rows, min_chars=40, min_docs=5):
    """Rows with their kept lines only."""
    holders = defaultdict(list)
    for i, t, _ in rows:
        for k in {line_key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    named = {k: [i for i in v if i is not None] for k, v in holders.items() if len(v) >= min_docs}
    first = {k: max(v) for k, v in named.items() if v}
    return [(i, "\n".join(x for x in (t or "").split("\n") if line_key(x) not in first or first[line_key(x)] == i), s) for i, t, s in rows]


# near duplicates --------------------------------------------------------------------------------


def shingles(text, k=5):
    words = WORD.findall(ascii_lower(text or ""))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def similar(x, y):
    return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)


def near_classes(rows):
    """id -> (set size, smallest reachable id), by all pairs."""
    sets = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in sets:
        for j, y in sets:
            if i < j and similar(x, y):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def near_stage(rows):
    """The rows that stay, each judged by its own text."""
    least = {}
    for i, t, _ in rows:
        if i is not None and (s := shingles(t)):
            least[s] = min(i, least.get(s, i))
    classes = {i: c for i, (_, c) in near_classes([(i, t, s) for i, t, s in rows if i is not None and least.get(shingles(t)) == i]).items()}
    return [(i, t, s) for i, t, s in rows if not (x := shingles(t)) or x not in least or classes[least[x]] == i]


# mixing -----------------------------------------------------------------------------------------


def mix_key(doc_id, text, seed=42):
    h = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    u = ((xxhash.xxh64_intdigest(struct.pack("<i", seed), h) >> 11) + 0.5) / 2**53
    text = text or ""
    weight = max(0.25, 1 - 4 * sum(c in "#*$%&|<>{}[]=~^_\\" for c in text) / len(text)) if text else 1.0
    return -math.log(u) / weight


def mix_targets(size, weights=(1, 2, 3), epochs=3):
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(size.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > epochs * size[s]}
        if not over:
            return want | {s: left * weight[s] / w for s in free}
        want |= {s: float(epochs * size[s]) for s in over}
        left, free = left - sum(epochs * size[s] for s in over), free - over
    return want


def mix_times(rows, epochs=3):
    """How often each row is taken, in order of rows: keys in order, up to the nearer side of the budget."""
    n = [len(WORD.findall(t or "")) for _, t, _ in rows]
    size = Counter()
    for (_, _, s), k in zip(rows, n, strict=True):
        size[s] += k
    want = mix_targets(size)
    place = [(mix_key(i, t), i is None, i or 0) for i, t, _ in rows]
    cut = {}
    for s in size:
        full = min(epochs, int(want[s] // size[s])) if size[s] else 0
        budget, docs = want[s] - full * size[s], Counter()
        for x, p, k in zip(rows, place, n, strict=True):
            if x[2] == s:
                docs[p] += k
        upto, last = 0, None
        for p in sorted(docs):
            upto += docs[p]
            if upto - docs[p] / 2 <= budget:
                last = p
        cut[s] = full, last
    return [(cut[x[2]][0] + (cut[x[2]][1] is not None and p <= cut[x[2]][1])) * (k > 0) for x, p, k in zip(rows, place, n, strict=True)]


def digest(data):
    return hashlib.sha256(data).hexdigest()
