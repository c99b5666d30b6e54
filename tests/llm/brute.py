"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import string

import numpy as np
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def benchmark_hits(docs, items, width=10):
    patterns = collections.defaultdict(set)
    for name, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            patterns[tuple(w[k : k + width])].add("" if name is None else str(name))
    sizes = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                names = patterns.get(tuple(w[k : k + m]))
                if names:
                    hit |= set(range(k, k + m))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def measures(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = SPACED.findall(text)
        seen, covered = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    return out


def fingerprint(text):
    w = SPACED.findall((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components(values, limit=4):
    """Smallest index reachable for each fingerprint."""
    v = np.array(values, np.uint64)
    up = list(range(len(v)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= limit), strict=True):
        a, b = find(x), find(y)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def secrets(text):
    text = text or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    return (*[sum(k == j for _, k, _ in spans) for j in range(3)], ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)))


def substrings(docs, width=50):
    words = {doc: SPACED.findall(text or "") for doc, text in docs}
    first = {}
    for doc, w in words.items():
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < doc:
                gone |= set(range(i, i + width))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def suffixes(docs, width=100):
    first = {}
    for doc, text in sorted(docs):
        b = (text or "").encode()
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], (doc, i))
    out = []
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (doc, i):
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def line_chunks(text, hash_line, hash_pair, divisor=4):
    """(start, body) of multi-line chunks, given the hash functions."""
    lines = (text or "").split("\n")
    h = [hash_line(x) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or hash_pair(h[i - 1] if i else None, h[i]) % divisor == 0:
            if i + 1 - start > 1 and SPACED.search("\n".join(lines[start : i + 1])):
                out.append((start, "\n".join(lines[start : i + 1])))
            start = i + 1
    return out


_FOLD = {**{c: i for i, c in enumerate(string.ascii_lowercase)}, **{c: i for i, c in enumerate(string.ascii_uppercase)}, **{c: 26 for c in string.digits}, **{c: 27 for c in "+/_-"}}
_SETS = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase, string.ascii_uppercase + string.ascii_lowercase, string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase]
_SETS += [string.ascii_uppercase + string.ascii_lowercase + string.digits + x for x in ("", "+/", "-_", "+/-_")]


def _random_p(codes, k):
    """Fisher's combination of chi-squared, runs and serial correlation."""
    n = len(codes)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi, df = sum((codes.count(c) - n / k) ** 2 for c in range(k)) * k / n, k - 1
    ps = [tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))]
    high = [c >= (k - 1) / 2 for c in codes]
    a, b = sum(high), n - sum(high)
    if not a or not b:
        ps += [2.0 ** (1 - n)] * 2
    else:
        runs, mean = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False)), 1 + 2 * a * b / n
        ps.append(2 * tail(abs(runs - mean) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))))
        mid = sum(codes) / n
        x = [c - mid for c in codes]
        ps.append(2 * tail(abs(sum(p * q for p, q in zip(x, x[1:], strict=False)) / max(1e-9, sum(p * p for p in x)) + 1 / n) * math.sqrt(n)))
    t = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-t) * (1 + t + t * t / 2)


def random_tokens(docs, expected, q=0.01):
    """Spans of random tokens by the battery, the text model and the step-up procedure, over all documents."""
    pairs = collections.Counter()
    for _, text in docs:
        codes = [_FOLD.get(chr(c), 28) if c < 128 else 28 for c in (text or "").encode()]
        pairs.update(zip(codes, codes[1:], strict=False))
    seen = collections.Counter()
    for (a, b), n in pairs.items():
        seen[a] += n * (b < 28)
    found = collections.defaultdict(list)
    for doc, text in docs:
        base = secrets(text)[3]
        taken = [tuple(map(int, x.split(":")[1:])) for x in base.split(",") if x]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?", text or ""):
            body = m[0].rstrip("=")
            which = next(i for i, letters in enumerate(_SETS) if set(body) <= set(letters))
            letters, p = _SETS[which], 1.0
            if which and _random_p([letters.index(c) for c in body], len(letters)) >= 0.001:
                log = len(body) * math.log(len(letters))
                for x, y in zip([28, *[_FOLD[c] for c in body]], [_FOLD[c] for c in body], strict=False):
                    log += math.log(0.75 * (pairs[x, y] + 1000 * expected[y]) / (seen[x] + 1000) + 0.25 / 28) - {26: math.log(10), 27: math.log(4)}.get(y, 0)
                case = [c.isupper() for c in body if c.isalpha()]
                for x, y in zip(case, case[1:], strict=False):
                    log += math.log(0.25 if x != y else 0.75)
                p = math.exp(min(0.0, log))
            n = len(m[0])
            step = min(399, int(-20 * math.log10(max(p, 1e-19))))
            found[n // 16 if n < 128 else n.bit_length()].append((10 ** (-step / 20), doc, m.start(), m.end(), any(s < m.end() and m.start() < e for s, e in taken)))
    out = []
    for tokens in found.values():
        tokens.sort(key=lambda t: -t[0])
        for i, (p, *_) in enumerate(tokens):
            if p <= q * (len(tokens) - i) / len(tokens):
                out += [t[1:4] for t in tokens[i:] if not t[4]]
                break
    return sorted(out, key=str)


def posterior(patterns, kinds, prior_of, votes=(1, 0, -1)):
    """Posterior of the good class for each pattern of votes (a dict of rule -> vote, with its count), by plain expectation-maximisation."""
    names, own = list(patterns[0][0]), [(), *kinds.values()]
    start = prior_of(names)
    share0 = [0.7] + [0.3 / len(kinds)] * len(kinds)
    share, rate = list(share0), [{r: dict(zip(votes, c[r], strict=True)) for r in names} for c in start]
    total = sum(n for _, n in patterns)
    for _ in range(3000):
        weights = []
        for v, n in patterns:
            odds = [share[c] * math.prod(rate[c][r][v[r]] for r in names) for c in range(len(own))]
            weights.append([n * x / sum(odds) for x in odds])
        share = [(sum(w[c] for w in weights) + 2 * share0[c]) / (total + 2) for c in range(len(own))]
        rate = [
            {r: {x: (sum(w[k] for (v, _), w in zip(patterns, weights, strict=True) if v[r] == x for k in pool) + 2 * start[c][r][i]) / (sum(w[k] for w in weights for k in pool) + 2) for i, x in enumerate(votes)} for r in names for pool in [[c] if r in own[c] else [k for k in range(len(own)) if r not in own[k]]]}
            for c in range(len(own))
        ]
    return [w[0] / n for w, (_, n) in zip(weights, patterns, strict=True)]


def ftrl(rows, p):
    """Weights of each slot after follow-the-regularised-leader updates, one dictionary entry at a time."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for epoch in range(p.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows[k]
            w = {i: weight(i) for i in x}
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * x[i] for i in x))))) - y
            for i, v in x.items():
                g = error * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


BLANK = re.compile(r"[^\x20\x09-\x0D]")


def _damage(rows):
    import zlib

    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def _cheapest(rows):
    """(cost, audit, repaired lines) by recursion from the end, over (row, state)."""
    import functools

    names = {"u": "user", "a": "assistant"}
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        role = "a" if state == "u" else "u"
        if inserted < 3:
            c, audit, lines = best(i, role, inserted + 1)
            found.append((c + 3, "I" + audit, (names[role] + ":", *lines)))
        if i < len(rows):
            own, text, fault = rows[i]
            c, audit, lines = best(i + 1, state, 0)
            found.append((c + 4, "D" + audit, lines))
            flaw = 3 * (fault == "truncated")
            if fault not in ("blank", "duplicate"):
                c, audit, lines = best(i + 1, role, 0)
                found.append((c + 3 + flaw, "R" + audit, (f"{names[role]}:{text}", *lines)))
                to = step[state].get(own[:1]) if own else state
                if to is not None:
                    c, audit, lines = best(i + 1, to, 0)
                    found.append((c + flaw, "K" + audit, (f"{own}:{text}", *lines)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    return best(0, "", 0)


def conversations(rows, damage=True):
    """op13's rows for (conv_id, turn, role, text) rows."""
    every = {r[0] for r in rows}
    kept = collections.defaultdict(list)
    for conv, turn, role, text in _damage(rows) if damage else rows:
        kept[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text, turn))
    out = []
    for conv in every:
        mine, seen, counts, marked = sorted(kept[conv], key=lambda r: r[:2] + (r[2].encode(), r[3].encode())), set(), collections.Counter(), []
        for _, _, role, text, _ in mine:
            shown = BLANK.findall(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = [r[4] for r in mine if r[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = _cheapest(tuple(marked))
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines))))
    return out


def near_vectors(rows, least=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    width = max([len(v) for _, v in rows if v] or [1])

    def unit(v):
        if not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        x = np.zeros(width)
        x[: len(v)] = v
        x /= np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v in rows]
    good = [i for i, u in enumerate(units) if u is not None]
    links = {i: set() for i in range(len(rows))}
    if good:
        x = np.array([units[i] for i in good])
        for a, b in zip(*np.nonzero(x @ x.T >= least), strict=True):
            if a != b:
                links[good[a]].add(good[b])
    root = {}
    for i in links:
        if i in root:
            continue
        todo, members = [i], {i}
        while todo:
            new = links[todo.pop()] - members
            members |= new
            todo += new
        ids = [rows[j][0] for j in members if rows[j][0] is not None]
        for j in members:
            root[j] = min(ids) if ids else None
    return [(d, len(links[i]), root[i], d is not None and d == root[i]) for i, (d, _) in enumerate(rows)]


def ranked(docs, items, top=50):
    """(item_id, rank, doc_id, score) of every document for every item."""

    def words(text):
        return ALNUM.findall((text or "").translate(LOWER))

    bags = [(d, collections.Counter(words(t))) for d, t in docs]
    size = [sum(b.values()) for _, b in bags]
    n_docs, n_words = sum(n > 0 for n in size), sum(size)
    df = collections.Counter(t for _, b in bags for t in b)
    terms = collections.defaultdict(set)
    for item, text in items:
        terms[item] |= set(words(text))
    out = []
    for item, own in terms.items():
        scores = []
        for (doc, bag), n in zip(bags, size, strict=True):
            if n:
                m = 50 + 50 * n * n_docs // n_words
                scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in own if t in bag), doc is not None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:top]) if s < 0]
    return out
