"""Made-up texts, and plain walks over them that give what the operators must."""

import random
import re

import numpy as np

from readalong.llm import decontamination, license_scan, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, route long, label string, score double, rest string, digest string"


def made_texts():
    """Random prose with shared passages, near and exact copies, odd characters, one long text."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = prose(60)
    texts = [None, "", " \t\n", "one", "Two words", "a b c", "x" * 300, "x" * 120, "\x00 null byte", "tab\tand\x0bmore\x0c\r\n", "日本語 テキスト 日本語 テキスト", "<|endoftext|> marks  it "]
    for _ in range(24):
        texts.append(prose(r.randint(5, 160)))
    base = prose(120).split()
    for k in range(12):  # near copies, some only linked through others
        copy = list(base)
        for _ in range(k):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [f"{prose(20)} {shared} {prose(9)}" for _ in range(4)]
    texts += [texts[14], texts[15].upper(), f"{shared}\n{shared}", prose(6000), " ".join(["again and"] * 200)]
    return texts


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def windows_gone(rows):
    seen, out = set(), []
    for i, t in sorted(set((i, t or "") for i, t in rows)):
        words = WORD.findall(t)
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return {r[0]: r for r in out}


def bytes_gone(rows, width=50):
    first, out = {}, {}
    for i, t in sorted(set((i, t or "") for i, t in rows)):
        data = t.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            if first.setdefault(data[s : s + width], i) < i:
                gone[s : s + width] = b"\1" * width
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone))]
        out[i] = (i, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def shingles(text, size):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def near_classes(rows, percent, size):
    rows = sorted(set((i, t or "") for i, t in rows))
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(v):
        return v if up[v] == v else root(up[v])

    for i, s in sets.items():
        for j, o in sets.items():
            if i < j and s and o and 100 * len(s & o) >= percent * len(s | o):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (i, len(s), root(i)) for i, s in sets.items()}


def levenshtein_in(item, text):
    """Least edit distance of item to any part of text."""
    row = [0] * (len(text) + 1)
    for a, c in enumerate(item, 1):
        new = [a]
        for b, d in enumerate(text, 1):
            new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (c != d)))
        row = new
    return min(row)


def plain_score(model, text):
    """A quality score by a walk over the text and the model's tables."""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    n = max(1, len(raw))
    named = {name: sum(b in members for b in raw) / n for name, members in quality.CLASSES}
    known = set(b"".join(members for _, members in quality.CLASSES))
    named |= {"beyond_ascii": sum(b >= 128 for b in raw) / n, "other": sum(b < 128 and b not in known and not 97 <= b <= 122 for b in raw) / n, "log_bytes": np.log1p(len(raw))}
    pairs = list(zip(words, words[1:], strict=False))
    named |= dict.fromkeys(("word_length", "distinct_words", "distinct_pairs", "distinct_lines", "longest_word"), 0.0)
    if words:
        named |= {"word_length": sum(map(len, words)) / len(words), "distinct_words": len(set(words)) / len(words), "distinct_pairs": len(set(pairs)) / max(1, len(pairs)), "distinct_lines": len(set(lines)) / len(lines), "longest_word": np.log1p(max(map(len, words)))}
    bins = [sum(c <= named[f] for c in cuts) for f, cuts in zip(quality.FEATURES, model.cuts, strict=True)]
    total = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
    coarse = [b * quality.COARSE // (len(c) + 1) for b, c in zip(bins, model.cuts, strict=True)]
    total += sum(t[coarse[a], coarse[b]] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
    return 1 / (1 + np.exp(-total))


def held_in(items, text):
    """(item, edits) of the benchmark items that stand in a text."""
    out = set()
    body = decontamination.folded(text or "")
    for number, item in set(items):
        f = decontamination.folded(item or "")
        if not f:
            continue
        if len(f) >= decontamination.LEAST_CHARS:
            d = levenshtein_in(f, body)
            if d <= decontamination.budget(f):
                out.add((number, d))
        elif decontamination.found(f, body) >= 0:
            out.add((number, 0))
    return out


def licences(texts):
    """(n_words, places of base phrases, base labels, labels, score) of each text, by a walk over its words."""
    split = [re.findall(license_scan.WORD, (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    sought = {w for _, template, _ in license_scan.TEMPLATES for w in template.split()} - license_scan.COMMON
    idf = {w: np.log((len(texts) + 1) / (sum(w in set(ws) for ws in split) + 1)) + 1 for w in sought}
    out = []
    for ws in split:
        stands = lambda parts, at, ws=ws: at >= 0 and ws[at : at + len(parts)] == parts
        places, base, labels, best = [], set(), set(), 0.0
        for phrase, label in license_scan.BASE_PHRASES:
            at = [k for k in range(len(ws)) if stands(phrase.split(), k)]
            places += at
            base |= {label} if at else set()
        for label, template, phrases in license_scan.TEMPLATES:
            parts, phrase = template.split(), phrases[0].split()
            i = next(i for i in range(len(parts)) if parts[i : i + len(phrase)] == phrase)
            for k in range(len(ws)):
                if stands(phrase, k):
                    labels.add(label)
                    got = sum(idf.get(w, 0.0) for j, w in enumerate(parts) if 0 <= k - i + j < len(ws) and ws[k - i + j] == w)
                    best = max(best, got / sum(idf.get(w, 0.0) for w in parts))
        out.append((len(ws), places, base, base | labels, best if labels else 0.5 if places else 0.0))
    return out
