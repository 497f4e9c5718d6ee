"""Plain versions of the operators, one text at a time."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORDS.findall(text or "")


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def removed(texts, window=35):
    """For each text: number of words, of removed words, hash of the kept words."""
    all_words = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[k : k + window]) for w in all_words for k in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def spans_text(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)


def fingerprint(text, width=3):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


def components(prints, distance=2):
    """For each print the number of its group."""
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                group[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    mark = [False] * len(w)
    for k in range(len(w) - 7):
        if seen[tuple(w[k : k + 8])] > 1:
            mark[k : k + 8] = [True] * 8
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    repeats = sum(mark)
    failed = len(w) < 20 or 100 * repeats > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, failed


def unigram(rows):
    """rows: (id, text). For each: held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = [words((t or "").translate(LOWER)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    count = collections.Counter(x for w, h in zip(tokens, held) if not h for x in w)
    n, v = sum(count.values()), len(count)
    return [
        (h, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        for w, h in zip(tokens, held)
    ]


def hits(texts, items, ngram=10):
    """items: (id, text). For each text: n_words, n_hit, n_items, hash of the items, contaminated."""
    known = collections.defaultdict(set)
    for i, t in items:
        w = ITEM_WORDS.findall((t or "").translate(LOWER))
        n = min(ngram, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known[tuple(w[k : k + n])].add(i)
    out = []
    for t in texts:
        w = ITEM_WORDS.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in known}:
            for k in range(len(w) - n + 1):
                own = known.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit[k : k + n] = [True] * n
        found.discard(None)
        out.append((len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), sum(hit) > 0))
    return out
