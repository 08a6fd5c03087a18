"""Plain one-document-at-a-time versions of the corpus operators, to compare with."""

import collections
import hashlib
import itertools
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def personal(text):
    text = text or ""
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    }
    return (*map(len, found.values()), sha(",".join(f"{k}:{a}:{b}" for k, v in found.items() for a, b in v)))


def secrets(text):
    text = text or ""
    assign = [m.span() for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    access = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hexes = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    marks = sorted((a, r, k, b) for r, (k, v) in enumerate([("assign", assign), ("access", access), ("hex", hexes)]) for a, b in v)
    return len(assign), len(access), len(hexes), sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in marks))


def entropy(window):
    n = len(window)
    return -sum(c / n * math.log2(c / n) for c in collections.Counter(window).values())


def near(rows, size, percent=80):
    """{doc_id: (set size, component)} of (doc_id, text)."""
    sets = {}
    for i, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        k = min(size, len(words))
        sets[i] = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def substring(rows, window=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k:k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def repeated_bytes(texts, length):
    count = collections.Counter(b[k:k + length] for b in texts for k in range(len(b) - length + 1))
    for b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        yield gone


def suffix(rows, length=400, short=256):
    texts = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, b), gone, shared in zip(texts, repeated_bytes([b for _, b in texts], length), repeated_bytes([b for _, b in texts], short)):
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)), sum(shared)))
    return sorted(out, key=str)


def overlaps(docs, items, window=13, least=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            b = words(item)
            n = len(b)
            need = -(-min(window, n) * least // window)
            best, first = 0, None
            for shift in range(-n + 1, len(w)):
                same = [0 <= q + shift < len(w) and w[q + shift] == b[q] for q in range(n)]
                for q in range(n):
                    c = sum(same[q:q + window])
                    if same[q] and c >= need:
                        best = max(best, c)
                        first = q + shift if first is None else min(first, q + shift)
            if best:
                out.append((d, i, best, first))
    return sorted(out, key=str)


def shards(rows, limit, bits=60):
    """{doc_id: (bytes, bits of the shard, depth, shard bytes, shard rows)} of (doc_id, bytes)."""
    out = {}

    def split(some, depth, prefix):
        total = sum(n for _, n, _ in some)
        if total <= limit:
            out.update({i: (n, prefix, depth, total, len(some)) for i, n, _ in some})
            return
        for bit in (0, 1):
            split([x for x in some if x[2] >> (bits - 1 - depth) & 1 == bit], depth + 1, prefix + str(bit))

    split([(i, n, int(hashlib.md5(str(i).encode()).hexdigest()[:bits // 4], 16)) for i, n in rows], 0, "")
    return out


def resampled(rows, target, buckets=10_000):
    """{doc_id: (features, weight, score, rank)} of (doc_id, text) with one row per id."""
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = (collections.Counter(k for x in texts for k in features(x)[1]) for texts in ([x for _, x in rows], target))
    S, T = s.total(), t.total()
    out = {}
    for i, text in rows:
        n, fs = features(text)
        gains = [math.floor(1000 * math.log((t[k] + 1) * (S + buckets) / ((s[k] + 1) * (T + buckets)))) for k in fs]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = (n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    fit = sorted((i for i in out if out[i][0] >= 20), key=lambda i: (-out[i][3], i))
    rank = {i: k + 1 for k, i in enumerate(fit[:25 * len(fit) // 100])}
    return {i: (*v[1:], rank.get(i)) for i, v in out.items()}


def codes(rows, parts=4, entries=256, rounds=4):
    """[(vec_id, code, error, label_error)] and the code books of (vec_id, vector, label)."""
    rows = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(rows[0][1]) // parts if rows else 0
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width:(p + 1) * width] for r in first] for p in range(parts)]

    def assigned(p):
        cut = [r[1][p * width:(p + 1) * width] for r in rows]
        return [(x, *min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))) for x in cut]

    for _ in range(rounds):
        for p in range(parts):
            at = collections.defaultdict(list)
            for x, _, k in assigned(p):
                at[k].append(x)
            for k, xs in at.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    by_part = [assigned(p) for p in range(parts)]
    errors = [sum(a[j][1] for a in by_part) for j in range(len(rows))]
    total = collections.Counter()
    for (_, _, label), e in zip(rows, errors):
        total[label] += e
    return [(i, "".join(f"{a[j][2]:02x}" for a in by_part), errors[j], total[label]) for j, (i, _, label) in enumerate(rows)], books
