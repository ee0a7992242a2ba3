"""Plain versions of the operators: dictionaries and nested loops over small fixtures."""

import re
import string

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(nodes, linked):
    """Smallest member of each node's component; linked(a, b) over all pairs."""
    label = {n: n for n in nodes}

    def find(n):
        while label[n] != n:
            n = label[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {n: find(n) for n in nodes}


def near(docs, n, up, down):
    """doc -> component for {doc: text}, links where down * intersection >= up * union."""
    sets = {d: shingles(t, n) for d, t in docs.items()}
    return groups(sets, lambda a, b: bool(sets[a]) and bool(sets[b]) and down * len(sets[a] & sets[b]) >= up * len(sets[a] | sets[b]))


def one_edit(a, b):
    """Levenshtein distance of word lists is 1 at most, by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 1


def clean_lines(docs, near_words):
    """{doc: (text after removal, lines with words, removed)} for {doc: text}, documents in order of id."""
    seen, out = [], {}
    order = [(d, i, line, words(line)) for d in sorted(docs) for i, line in enumerate((docs[d] or "").split("\n"))]
    gone = set()
    for d, i, _, w in order:
        if not w:
            continue
        if any(v == w or len(v) >= near_words and len(w) >= near_words and abs(len(v) - len(w)) <= 1 and len(set(v) ^ set(w)) <= 2 and one_edit(v, w) for v in seen):
            gone.add((d, i))
        seen.append(w)
    for d, text in docs.items():
        own = [(i, line, w) for e, i, line, w in order if e == d]
        kept = [line for i, line, _ in own if (d, i) not in gone]
        out[d] = (text if len(kept) == len(own) else "\n".join(kept), sum(bool(w) for *_, w in own), len(own) - len(kept))
    return out


def template(text, units):
    """(template token, plain token, is slot) of each token that holds a letter or digit."""
    out, before, opens = [], None, True
    for line in (text or "").split("\n"):
        opens = True
        for raw in re.findall(r"[^\x20\x09-\x0D]+", line):
            plain = re.sub(r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]", "", raw)
            if plain:
                low = plain.lower()
                number = low.isascii() and low.isdigit()
                name = plain[0].isupper() and sum(c.isupper() for c in plain) == 1 and not opens
                kind = "<number>" if number else "<unit>" if before == "<number>" and low in units else "<name>" if name else low
                out.append((kind, low, kind.startswith("<")))
                before = kind
            opens = bool(re.search(r"[.!?:]", raw[-2:]))
    return out


def leaks(docs, items, units, size=5, share=0.8):
    """Pairs (doc, item) with enough common template windows; slots are not checked."""
    cut = lambda t: {tuple(x[0] for x in t[i : i + size]) for i in range(max(1, len(t) - size + 1))} if t else set()
    own = {i: cut(template(t, units)) for i, t in items.items()}
    theirs = {d: cut(template(t, units)) for d, t in docs.items()}
    return {(d, i) for d, x in theirs.items() for i, y in own.items() if y and len(x & y) >= share * len(y)}
