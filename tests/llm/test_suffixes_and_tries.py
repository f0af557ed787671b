"""Maximal repeats, spelling variants, periodic runs: brute-force versions, edge cases, and the registered queries."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF_SMALL

from kbspark.llm import periodic, queries, repeats, spelling
from kbspark.llm.arrowtext import mix
from kbspark.llm.suffixes import Stretches, WaveletTree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, sha string, node string, key long, anchor int"
# Null and empty texts and keys, repeated rows, a long text, and columns whose names the operators use themselves.
EDGE = [(1, None, "s", "n", 1, 2), (2, "", "s", "n", 1, 2), (None, "lonely words", "s", "n", None, 2),
        (3, "tick tock " * 40, "s", "n", 1, 2), (3, "tick tock " * 40, "s", "n", 1, 2), (5, " \n\t ", "s", "n", 1, 2),
        (6, "long " * 200_000 + "end", None, "n", 1, 2), (7, "漢字 é x\x1c!! " * 30, "s", "n", 1, 2)]


def sf_documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_wavelet_tree_and_stretches():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 500, 700)
    tree = WaveletTree(values)
    lo = rng.integers(0, 700, 400)
    hi = np.minimum(700, lo + rng.integers(0, 200, 400))
    bound = rng.integers(0, 700, 400)
    for a, b, x, n, s in zip(lo, hi, bound, tree.below(lo, hi, bound), tree.successor(lo, hi, bound)):
        some = np.sort(values[a:b])
        assert n == (some < x).sum()
        assert s == (some[some >= x][0] if (some >= x).any() else -1)
    symbols = mix(rng.integers(0, 2, 300).astype(np.uint64))
    text = Stretches(symbols)
    i = rng.integers(0, 300, 500)
    j = np.minimum(300, i + rng.integers(0, 40, 500))
    for a, b, m, k in zip(i, j, text.ahead(i, j, 300 - j), text.behind(i, j, i)):
        assert m == next((x for x in range(300 - b) if symbols[a + x] != symbols[b + x]), 300 - b)
        assert k == next((x for x in range(a) if symbols[a - 1 - x] != symbols[b - 1 - x]), a)


# Maximal repeats

def brute_removed(texts, length):
    where = collections.Counter()
    for raw in texts:
        for i in range(len(raw) - length + 1):
            where[raw[i:i + length]] += 1
    out = []
    for raw in texts:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if where[raw[i:i + length]] > 1:
                gone[i:i + length] = True
        n = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum())
        out.append((len(raw), int(gone.sum()), n, digest(np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes())))
    return out


def made_texts(rng):
    def noise(n):
        return "".join(rng.choice("abcdefg é漢 ") for _ in range(n))

    def edited(s):
        s = list(s)
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = noise(1)
        return "".join(s)

    passages, base = [noise(rng.randrange(150, 900)) for _ in range(5)], noise(1200)
    texts = [None, "", "short", "a" * 700, "a" * 5000, "ab" * 400, noise(5) * 300, "x" * 199, "x" * 200, "y" * 200]
    texts += [edited(base) for _ in range(30)]
    texts += [noise(rng.randrange(400)) + rng.choice(passages) + noise(rng.randrange(300)) + edited(rng.choice(passages))
              for _ in range(40)]
    return texts + [texts[30]] * 3 + [passages[0]] * 2 + [noise(1000) for _ in range(15)]


@pytest.mark.parametrize("p", [repeats.RepeatParams(), repeats.RepeatParams(block=3000, window=2000, span=50),
                               repeats.RepeatParams(length=40, gram=8, block=900)])
def test_repeats_equal_brute_force(spark, p):
    texts = made_texts(random.Random(4))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repeats.remove(df, p).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed([(t or "").encode() for t in texts], p.length)


def test_maximal_repeats_are_all_intervals():
    """Against the definition: a string at two places or more that cannot grow to either side at all of them."""
    rng, p = random.Random(9), repeats.RepeatParams(length=4, gram=2)
    for _ in range(30):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(4, 30))) for _ in range(rng.randrange(1, 6))]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        at, common, left, _, _ = repeats.suffix_array(data, bounds, p)
        groups, longest = repeats.maximal_repeats(common, left)
        got = {(bytes(data[at[lo]:at[lo] + n]), tuple(sorted(at[lo:hi].tolist()))) for lo, hi, n in groups}
        places = collections.defaultdict(list)
        for k, x in enumerate(pieces):
            for i in range(len(x)):
                for n in range(4, len(x) - i + 1):
                    places[x[i:i + n]].append((k, i))
        want = set()
        for s, occ in places.items():
            before = {pieces[k][i - 1] if i else (k, i) for k, i in occ}
            after = {pieces[k][i + len(s)] if i + len(s) < len(pieces[k]) else (k, i) for k, i in occ}
            if len(occ) > 1 and len(before) > 1 and len(after) > 1:
                want.add((s, tuple(sorted(int(bounds[k]) + i for k, i in occ))))
        assert got == want
        best = {}
        for lo, hi, n in groups:
            for i in range(lo, hi):
                best[i] = max(best.get(i, 0), n)
        assert {i: int(n) for i, n in enumerate(longest) if n} == best


def test_sliding_least_and_pieces():
    values = np.random.default_rng(2).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 3, 7, 200, 201):
        want = [values[i:i + width].min() for i in range(200 - width + 1)]
        assert repeats.sliding_least(values, width).tolist() == want


def test_repeats_edges(spark):
    df = spark.createDataFrame(EDGE, DOCS)
    got = collections.Counter(map(tuple, repeats.remove(df).collect()))
    want = collections.Counter((r[0], *x) for r, x in zip(EDGE[:6] + EDGE[7:], brute_removed(
        [(r[1] or "").encode() for r in EDGE[:6] + EDGE[7:]], 200)))
    # All of the long text but its last word repeats.
    raw = EDGE[6][1].encode()
    want[(6, len(raw), len(raw) - 3, 1, digest(b"end"))] += 1
    assert got == want
    assert repeats.remove(df.limit(0)).count() == 0


def test_repeats_query(spark):
    rows = sf_documents()
    got = {r[0]: tuple(r)[1:] for r in queries.op11_maximal_repeats(spark, SF_SMALL).collect()}
    want = brute_removed([(t or "").encode() for _, t in rows], 200)
    assert [got[k] for k, _ in rows] == want


# Spelling variants

def brute_variants(count, ratio=5):
    near = collections.defaultdict(set)
    for w in count:
        for i in range(len(w)):
            near[("-", w[:i], w[i + 1:])].add(w)              # one replaced, or one deleted
    neighbours = {w: set() for w in count}
    for (_, a, b), ws in near.items():
        group = ws | ({a + b} if a + b in count else set())
        for w in ws:
            neighbours[w] |= {x for x in group if x != w}
            if a + b in count:
                neighbours[a + b].add(w)
    form = {}
    for w, ns in neighbours.items():
        best = min(ns, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, count[w], len(neighbours[w]), count[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("states", [20_000, 7])
def test_variants_equal_brute_force(spark, states):
    rng, count = random.Random(2), {}
    for _ in range(500):
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 9)))
        count[word] = rng.choice([5, 6, 25, 30, 125, 700, 3500])
    for k in range(60, 68):
        count["z" * k] = 5 ** (k - 59)
    vocab = spark.createDataFrame(list(count.items()), "word string, n long")
    got = list(map(tuple, spelling.group(vocab, spelling.VariantParams(states=states)).collect()))
    assert len(got) == len(count) and set(got) == brute_variants(count)


def test_variants_edges(spark):
    kinds = "word string, n long, node string, form string"
    rows = [(None, 9, "x", "y"), ("abcdef", 3, "x", "y"), ("abcdef", 2, None, "y"), ("abcdeg", 30, "x", None)]
    assert sorted(map(tuple, spelling.group(spark.createDataFrame(rows, kinds)).collect())) == [
        ("abcdef", "abcdeg", "abcdeg", 5, 1, 30), ("abcdeg", None, "abcdeg", 30, 1, None)]
    assert spelling.group(spark.createDataFrame([], kinds)).count() == 0
    assert list(map(tuple, spelling.group(spark.createDataFrame(rows[1:2], kinds)).collect())) == [
        ("abcdef", None, "abcdef", 3, 0, None)]


def test_variants_query(spark):
    count = collections.Counter()
    for doc, text in sf_documents():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    got = list(map(tuple, queries.op12_spelling_variants(spark, SF_SMALL).collect()))
    assert len(got) == len(words) and set(got) == brute_variants(words)
    edges = spark.createDataFrame([(None, "Ünïcode Ünïcode ABC"), (1, None), (2, "")], "doc_id long, text string")
    # Only A-Z are lowered; a null id deletes nothing.
    assert sorted(r.word for r in queries.typed_words(edges).collect()) == ["abc", "Ünïcode", "Ünïcode"]


# Periodic runs

def brute_runs(words, least=24):
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    t, out = np.array([codes[w] for w in words], np.int64), {}
    for q in range(1, len(t) // 3 + 1):
        edge = np.diff(np.concatenate([[0], (t[:-q] == t[q:]).astype(int), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a + q >= max(least, 3 * q):
                out.setdefault((int(a), int(b + q)), q)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def brute_digest(words):
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, digest(listed.encode()), digest(kept.encode()))


def made_words(rng):
    out, size = [], rng.choice([30, 80, 200, 500])
    while len(out) < size:
        kind = rng.randrange(5)
        if kind == 0:
            out += [rng.randrange(1000) for _ in range(rng.randrange(40))]
        elif kind == 1:
            q = rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 33, 40])
            letters = rng.choice([2, 2, 3, 50])
            root = [rng.randrange(letters) for _ in range(q)]
            out += (root * 10)[:int(q * rng.choice([2.5, 3, 3, 3.1, 4, 7])) + rng.randrange(3)]
        elif kind == 2:
            root = [1] * rng.randrange(1, 25) + [2] * rng.randrange(1, 25)
            root += [1] * rng.randrange(20) + [3] if rng.random() < .4 else []
            out += root * 3 + root[:rng.randrange(3)]
        elif kind == 3:
            root = [1, 2] * rng.randrange(3, 10) + [3, 2] * rng.randrange(3, 10) + [3] * rng.randrange(2)
            out += root * 3 + root[:rng.randrange(len(root))]
        else:
            x, y = [1], [1, 2]
            for _ in range(rng.randrange(3, 10)):
                x, y = y, y + x
            out += y
    return out


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        docs = [made_words(rng) for _ in range(8)]
        docs[3] = docs[2]
        words = mix(np.array(sum(docs, []), np.uint64) + np.uint64(7))
        row, start, length, period = periodic.find(words, np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
        for i, doc in enumerate(docs):
            own = row == i
            assert sorted(zip(start[own].tolist(), length[own].tolist(), period[own].tolist())) == brute_runs(doc)


def test_runs_edges(spark):
    df = spark.createDataFrame(EDGE, DOCS)
    got = collections.Counter(map(tuple, periodic.digest(periodic.detect(df)).collect()))
    want = collections.Counter((r[0], *brute_digest(WORD.findall(r[1] or ""))) for r in EDGE if r[0] != 6)
    want[(6, 1, 0, 200_000, 1, 200_000_000, digest(b"0,200000,1\n"), digest(b"long end"))] += 1
    assert got == want
    assert periodic.digest(periodic.detect(df.limit(0))).count() == 0


def test_runs_query(spark):
    got = {r[0]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF_SMALL).collect()}
    hits = 0
    for doc, text in sf_documents():
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert got[doc] == brute_digest(words)
        hits += got[doc][0]
    assert len(got) == len(sf_documents()) and hits > 0
