"""Alignment of two texts' words: most matches first, then fewest chunks.

Words match if they are equal, else by their stems, else by a common group of synonyms; as many as can be are matched in the first way, then as
many more as can be in the second, then in the third.  Of all such alignments one with few *chunks* is sought, runs of words that are
neighbours in both texts.  How many words match each way is known from counts alone; so a search from left to right only
has to keep within what may stay unmatched at each level, and never runs into a dead end.

The search goes depth first: the place that goes on with the chunk before, then the one where the longest run of equal classes
begins, then the others; it turns back where the chunks so far, and breaks that no alignment can avoid, make no improvement possible.  Longest runs
come from a suffix automaton of the second text, built in linear time.  Fewest chunks are exact as long as the
search ends within ``BUDGET`` steps; beyond, the best alignment so far stands (finding fewest chunks is NP-hard).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

#: Steps of the search, besides one for each word.
BUDGET = 3000
#: Free places that are compared before the rest is taken in order, by so many words at most.
NEXT, FAR = 12, 16


def longest_runs(h: list[int], r: list[int]) -> list[tuple[int, int]]:
    """For each place of h, the length of the longest run from there that stands in r too, and where it begins there.

    The automaton is of r backwards, so walking h from its end gives what begins at a place.
    """
    step: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [0]
    last = 0
    for k, c in enumerate(reversed(r)):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(len(r) - 1 - k)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out, state, n = [], 0, 0
    for c in reversed(h):
        while state and c not in step[state]:
            state = link[state]
            n = length[state]
        if c in step[state]:
            state, n = step[state][c], n + 1
        else:
            n = 0
        out.append((n, end[state]))
    return out[::-1]


def align(h: list[tuple], r: list[tuple], budget: int = BUDGET) -> tuple[int, int, bool]:
    """Matches, chunks, and whether these are surely the fewest, of two texts whose words are tuples of keys, from the strictest level on.

    Words with an equal key at one level have equal keys at all later ones.
    """
    if not h or not r:
        return 0, 0, True
    levels = len(h[0])
    # words of either text that each level may leave to the next, by key
    spare: list[list[dict]] = []
    matches = 0
    for k in range(levels):
        a, b = Counter(x[k] for x in h), Counter(x[k] for x in r)
        spare.append([{c: max(0, a[c] - b[c]) for c in a}, {c: max(0, b[c] - a[c]) for c in b}])
        matches = (a & b).total()  # at the last level, all
    if not matches:
        return 0, 0, True
    numbers: dict = {}
    hc, rc = ([numbers.setdefault(x[-1], len(numbers)) for x in t] for t in (h, r))
    # the free places of r of each key, in order, as rings that begin and end behind r; what is taken out last is put back first
    after, ahead, ring = list(range(len(r))), list(range(len(r))), {}
    for j, c in enumerate(rc):
        if c not in ring:
            ring[c] = len(after)
            after.append(len(after))
            ahead.append(len(ahead))
        z = ring[c]
        after[j], ahead[j] = z, ahead[z]
        after[ahead[z]], ahead[z] = j, j
    runs = longest_runs(hc, rc)
    pairs = set(zip(rc, rc[1:], strict=False))
    # a word that has to match, after one that can't be its neighbour in r, begins a chunk in any case
    must = [spare[-1][0][x[-1]] == 0 for x in h]
    breaks = [0] * (len(h) + 1)
    for i in range(len(h) - 1, -1, -1):
        breaks[i] = breaks[i + 1] + (must[i] and (i == 0 or (hc[i - 1], hc[i]) not in pairs))

    # the counts of ``spare`` as lists, by the keys' numbers
    hn, rn, hs, rs = [[] for _ in h], [[] for _ in r], [], []
    for k, (a, b) in enumerate(spare):
        ha, rb = ({c: x for x, c in enumerate(t)} for t in (a, b))
        hs.append(list(a.values()))
        rs.append(list(b.values()))
        for x, w in zip(hn, h, strict=True):
            x.append(ha[w[k]])
        for x, w in zip(rn, r, strict=True):
            x.append(rb[w[k]])
    small = len(h) * len(r) <= 4096  # states are remembered where they can come again soon
    # what of them the words of h have used up is one number, in which each has a digit of its own: equal numbers are equal counts
    digit, base = [], 1
    for counts in hs:
        digit.append([])
        for n in counts:
            digit[-1].append(base if small else 0)
            base *= n + 1 if small else 1

    used = bytearray(len(r))
    seen: dict = {}
    mask = gone = 0

    def choices(i: int, prev: int) -> Iterator[int]:
        """Places of r for word i, best first, then -1 for none."""
        c = hc[i]
        nxt = prev + 1
        if prev >= 0 and nxt < len(rc) and rc[nxt] == c:
            yield nxt
        else:
            nxt = -1
        n, j = runs[i]
        if n and j != nxt and not used[j]:
            yield j
        else:
            j = -1
        if c in ring:
            # of the next few free places, those first where more free words go on alike
            few, x = [], after[ring[c]]
            while x != ring[c] and len(few) < NEXT:
                if x != nxt and x != j:
                    few.append((-run(i, x), x))
                x = after[x]
            for _, y in sorted(few):
                yield y
            while x != ring[c]:
                if x != nxt and x != j:
                    yield x
                x = after[x]
        yield -1

    def run(i: int, j: int) -> int:
        n = 1
        while n < FAR and i + n < len(hc) and j + n < len(rc) and hc[i + n] == rc[j + n] and not used[j + n]:
            n += 1
        return n

    best, steps, exact = len(h) + 1, budget + len(h), True
    every = range(levels)
    stack: list[list] = [[choices(0, -2), -2, None, 0]]  # choices left, place before, (j, level) taken, chunks before
    while stack:
        top = stack[-1]
        i = len(stack) - 1
        options, prev, taken, chunks = top
        own = hn[i]
        if taken is not None:
            j, k = taken
            for m in range(k):
                hs[m][own[m]] += 1
                gone -= digit[m][own[m]]
            if j >= 0:
                for m in range(k):
                    rs[m][rn[j][m]] += 1
                used[j] = 0
                after[ahead[j]] = ahead[after[j]] = j
                if small:
                    mask ^= 1 << j
            top[2] = None
        found = None
        for j in options:
            fresh = j >= 0 and not (prev >= 0 and j == prev + 1)
            now = chunks + fresh
            if now + breaks[i + 1] >= best:
                if fresh:  # so would any other place
                    options = top[0] = iter((-1,))
                    now = chunks
                    j = -1
                    if now + breaks[i + 1] >= best:
                        break
                    next(options)
                else:
                    continue
            # the level of the match, ``levels`` for none; words that have to match better must not be lost
            if j < 0:
                for m in every:
                    if not hs[m][own[m]]:
                        break
                else:
                    found = (j, levels, now)
                break
            if used[j]:
                continue
            k, a, b = 0, h[i], r[j]
            while a[k] != b[k]:
                if not hs[k][own[k]] or not rs[k][rn[j][k]]:
                    break
                k += 1
            else:
                found = (j, k, now)
                break
        if found is None:
            stack.pop()
            continue
        steps -= 1
        if steps < 0 and best <= len(h):
            exact = False
            break
        j, k, now = found
        for m in range(k):
            hs[m][own[m]] -= 1
            gone += digit[m][own[m]]
        if j >= 0:
            for m in range(k):
                rs[m][rn[j][m]] -= 1
            used[j] = 1
            after[ahead[j]], ahead[after[j]] = after[j], ahead[j]
            if small:
                mask |= 1 << j
        top[2] = (j, k)
        if i + 1 == len(h):
            best = min(best, now)
            continue
        if small:
            key = (i, j, mask, gone)
            if seen.get(key, best) <= now:
                continue
            seen[key] = now
        stack.append([choices(i + 1, j), j, None, now])
    return matches, best, exact


def keys_of(words: list[str], stem: Callable[[str], str], synonyms: dict[str, str] | None = None) -> list[tuple]:
    """Each word, its stem, and the group of synonyms of its stem, of which a group's name or the stem itself stands for it."""
    out = []
    for w in words:
        s = stem(w)
        out.append((w, s) if synonyms is None else (w, s, synonyms.get(s, "\0" + s)))
    return out
