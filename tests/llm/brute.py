"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def chat(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv_id, turn, role, text)."""
    out = {}
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role or "", text or ""))
    for conv, turns in convs.items():
        turns.sort(key=lambda t: t[0])
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (
            len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        )
    return out


def near(docs, k, percent):
    """{doc_id: (n_shingles, component)}."""
    sets = {}
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        common = Counter(o for x in s for o in holders[x] if o < d)
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def substrings(docs, size=50):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        own = set()
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            own.add(w)
            if w in seen:
                gone[i : i + size] = b"\x01" * size
        seen |= own
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if wins[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def warc(pages):
    """[(page_id, bytes, digest, type, refers_to)]."""
    first = {}
    rows = [(p, (h or "").encode()) for p, h in pages]
    for p, b in rows:
        if len(b) >= 100:
            first[b] = min(first.get(b, p), p)
    return [
        (p, len(b), hashlib.sha256(b).hexdigest(), *(("revisit", first[b]) if first.get(b, p) < p else ("response", None)))
        for p, b in rows
    ]


def tokens(texts, end):
    """Ids of each text with its end id, as bytes."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4").tobytes() for x in texts]
