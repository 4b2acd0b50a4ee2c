"""Plain versions of the operators' results, one document after the other, for small tables."""

import hashlib
import html
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import xxhash

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def token_counts(docs):
    own = pieces()
    out = []
    for doc, text in docs:
        n = len(own.encode(text or ""))
        out.append((doc, len((text or "").encode()), n, n > 4096))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontaminate(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = bench_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words = bench_words(text)
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (own := windows.get(tuple(words[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def rules(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, duplicates = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                duplicates += line in seen
                seen.add(line)
        where = {}
        for i in range(len(words) - 2):
            where.setdefault(tuple(words[i : i + 3]), []).append(i)
        inside = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
        n, repeated = len(words), len(inside)
        failed = n < 50 or 100 * repeated > 50 * n
        out.append((doc, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, repeated, failed))
    return out


def flat_article(page):
    """The blocks of a page whose article has no elements but headings, paragraphs, bold text and line breaks."""
    inner = re.search(r"<article>(.*)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
    texts = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def personal_data(docs):
    out = []
    for doc, text in docs:
        spans = base_spans(text or "")
        label = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        out.append((doc, *[sum(k == x for k, _, _ in spans) for x in PATTERNS], hashlib.sha256(label.encode()).hexdigest(), label))
    return out


def token_files(docs, end_id=1):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def simhash(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    """The smallest node that each of some comparable nodes reaches."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def simhash_classes(docs, width=3, distance=2):
    prints = {doc: simhash(text, width) for doc, text in docs}
    linked = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= distance]
    found = classes(prints, linked)
    return [(doc, f"{fp:016x}", found[doc]) for doc, fp in prints.items()]


def edits(a, b, most):
    """Whether two texts lie within so many edits."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        if min(row) > most:
            return False
    return row[-1] <= most


def line_dedup(docs, min_chars=20, max_edits=2):
    """(doc, text, n_lines, n_removed); docs with distinct ids."""
    seen, flat, out = set(), [], []
    counts = np.zeros((sum((t or "").count("\n") + 1 for _, t in docs), 97), np.int16)
    for doc, text in sorted(docs):
        kept, removed = [], 0
        lines = (text or "").split("\n")
        for line in lines:
            own = line.strip(" ")
            if len(own) < min_chars:
                kept.append(line)
                continue
            if own in seen:
                removed += 1
                continue
            vector = np.bincount(np.array([ord(c) % 97 for c in own]), minlength=97).astype(np.int16)
            near = False
            if flat:
                close = np.abs(counts[: len(flat)] - vector).sum(axis=1) <= 2 * max_edits
                near = any(abs(len(flat[i]) - len(own)) <= max_edits and edits(own, flat[i], max_edits) for i in np.flatnonzero(close))
            seen.add(own)
            counts[len(flat)] = vector
            flat.append(own)
            if near:
                removed += 1
            else:
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), removed))
    return out
