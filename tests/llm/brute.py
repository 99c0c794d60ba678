"""Plain loops that the operators are held against."""

import bisect
import re
from collections import Counter

import numpy as np

from loomgraph.llm import chat
from loomgraph.llm.langid import length_class
from loomgraph.llm.textvec import LETTERS
from loomgraph.llm.tokens import encode, rank_path


def trigrams(raw: bytes, dim: int) -> Counter:
    out = Counter()
    for i in range(len(raw) - 2):
        if raw[i : i + 2] != b"  ":
            x = 0
            for c in raw[i : i + 3]:
                x = (x * 0x01000193 + c) & 0xFFFFFFFF
            out[((x * 0x9E3779B1) & 0xFFFFFFFF) >> (33 - dim.bit_length())] += 1
    return out


def weighted(counts: Counter, idf, dim: int) -> np.ndarray:
    v = np.zeros(dim)
    for k, n in counts.items():
        v[k] = np.sqrt(n) * idf[k]
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def quality_score(model, doc_id, text) -> tuple[float | None, bool]:
    """(score, whether the k-th and the next neighbour are clearly apart)."""
    v = weighted(trigrams((text or "").encode(), model.params.dim), model.idf, model.params.dim)
    if not v.any():
        return None, True
    v = v @ model.basis
    if not v.any():
        return None, True
    v /= np.linalg.norm(v)
    votes = sorted(((float(w @ v), y) for w, y, i in zip(model.vectors, model.labels, model.ids) if i != doc_id), reverse=True)
    k = model.params.k
    clear = len(votes) <= k or votes[k - 1][0] - votes[k][0] > 1e-5
    top = [(s, y) for s, y in votes[:k] if s > 0]
    return (sum(s * y for s, y in top) / sum(s for s, _ in top) if top else None), clear


def language(model, text) -> tuple[str | None, float | None, bool]:
    if not text:
        return None, None, False
    raw = bytes(LETTERS[np.frombuffer(text.lower().encode(), np.uint8)])
    counts = trigrams(raw, model.params.dim)
    n = sum(counts.values())
    if not n:
        return None, None, False
    sims = model.centroids @ weighted(counts, model.idf, model.params.dim)
    best = int(np.argmax(sims))
    return model.languages[model.owner[best]], float(sims[best]), bool(1 - round(float(sims[best]), 6) <= model.max_distance[length_class(np.array([n]))[0]] + 1e-6)


def components(edges) -> dict:
    root: dict = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def signature_groups(sig: dict, threshold: float) -> tuple[list, dict]:
    """(pairs of ids, group of each id) from all pairs of signatures; a value may be a list of them."""
    flat = [(i, s) for i, x in sig.items() for s in (x if isinstance(x, list) else [x])]
    ids, m = [i for i, _ in flat], np.array([s for _, s in flat])
    pairs = [(ids[i], ids[i + 1 + j]) for i in range(len(ids)) for j in np.flatnonzero((m[i + 1 :] == m[i]).mean(axis=1) >= threshold)]
    return pairs, components(pairs + [(i, i) for i in ids])


def jaccard_pairs(texts: dict, n: int, least: float) -> list:
    """Pairs of documents whose sets of word n-grams have at least this Jaccard similarity."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= n:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def vector_classes(x: np.ndarray, threshold: float) -> dict:
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= threshold
    np.fill_diagonal(link, False)
    group = components([(int(a), int(b)) for a, b in zip(*np.nonzero(link))] + [(i, i) for i in range(len(x))])
    return {i: (group[i], int(link[i].sum())) for i in range(len(x))}


def chat_spans(turns, budget: int, history: int) -> list[tuple[int, int, int, int]]:
    """(history from, new from, to, tokens) of each window, by trying every start."""
    n = [len(encode(rank_path(), chat.render(r, t))) for r, t in turns]
    lead = 1 if turns and turns[0][0] == "system" else 0
    base = sum(n[:lead])
    room = max(0, budget - base)
    out, at = [], lead
    while at < len(n):
        back = at
        while n[at] <= room and back > lead and sum(n[back - 1 : at]) <= min(history, room) and sum(n[back - 1 : at + 1]) <= room:
            back -= 1
        end = at + 1
        while end < len(n) and sum(n[back : end + 1]) <= room:
            end += 1
        out.append((back, at, end, base + sum(n[back:end])))
        at = end
    return out or [(1, 1, 1, base)]


def packed_fills(lengths, tiers) -> Counter:
    """(tier, tokens in the window) of best-fit packing, piece by piece: long tiers first, their gaps filled from shorter ones."""
    tiers, top, left = sorted(tiers), max(tiers), []
    for n in lengths:
        left += [top] * (n // top) + ([n % top] if n % top else [])
    out: Counter = Counter()
    for at in range(len(tiers) - 1, -1, -1):
        cap, low = tiers[at], tiers[at - 1] if at else 0
        gaps: list[int] = []
        rest = []
        for n in sorted((x for x in left if x <= cap), reverse=True):
            k = bisect.bisect_left(gaps, n)
            if k < len(gaps):
                bisect.insort(gaps, gaps.pop(k) - n)
            elif n > low:
                bisect.insort(gaps, cap - n)
            else:
                rest.append(n)
        out.update((cap, cap - g) for g in gaps)
        left = rest
    return out
