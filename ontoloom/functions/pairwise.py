"""String similarities of many pairs at once, as numpy arrays: the values of ``similarity``'s Columns.

``s`` and ``t`` are lists of labels, ``i`` and ``j`` say which of them are paired. What two sets have in common is a
product of matrices; edit distances and subsequences advance all pairs by one character a step, 63 bits a word.
"""

import numpy as np

from ontoloom.config import Settings
from ontoloom.functions.labels import STOPWORDS
from ontoloom.functions.similarity import _isub

DEFAULTS = Settings()
BITS = 63
FULL = np.uint64((1 << BITS) - 1)
ONE, LAST = np.uint64(1), np.uint64(BITS - 1)
#: pairs that advance together, and columns of a matrix of sets
STEP, WIDTH = 8192, 4096
#: of isub: bits of a limb; words of a step's runs; words of one pair's table at most; pairs of one limb whose tables are there at once
WORD, CELLS, MOST, NEAR = 64, 1 << 17, 1 << 20, 1 << 15
_STOP = frozenset(STOPWORDS)


def shared(left: list, right: list, weights: dict | None = None) -> np.ndarray:
    """For each set of ``left`` and of ``right`` the number of items that both have, or those items' weight."""
    at = {x: n for n, x in enumerate(sorted(set().union(*left) & set().union(*right)))}
    kind = np.float32 if weights is None else np.float64
    out = np.zeros((len(left), len(right)), kind)

    def places(sets):
        found = [(n, at[x]) for n, items in enumerate(sets) for x in items if x in at]
        return np.array(found, np.int64).reshape(-1, 2).T

    (sr, sc), (tr, tc) = places(left), places(right)
    worth = np.ones(len(at), kind) if weights is None else np.array([weights[x] for x in at], kind)
    for low in range(0, len(at), WIDTH):
        n = min(WIDTH, len(at) - low)
        a, b = np.zeros((len(left), n), kind), np.zeros((len(right), n), kind)
        here = (sc >= low) & (sc < low + n)
        a[sr[here], sc[here] - low] = worth[sc[here]]
        here = (tc >= low) & (tc < low + n)
        b[tr[here], tc[here] - low] = 1
        out += a @ b.T
    return out


def lengths(texts: list[str]) -> np.ndarray:
    return np.array([len(x) for x in texts], np.int64)


def equal(s: list[str], t: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    at: dict[str, int] = {}
    a, b = (np.array([at.setdefault(x, len(at)) for x in texts], np.int64) for texts in (s, t))
    return a[i] == b[j]


def _jaccard(left: list, right: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    m = shared(left, right)[i, j].astype(np.float64)
    n = lengths(left)[i] + lengths(right)[j] - m
    return np.divide(m, n, out=np.zeros(len(m)), where=m > 0)


def _grams(texts: list[str], n: int) -> list[set]:
    return [{x[k : k + n] for k in range(len(x) - n + 1)} for x in texts]


def ngram(s, t, i, j, n: int = 3) -> np.ndarray:
    """As similarity.ngram_similarity, of labels in lower case."""
    short = np.minimum(lengths(s)[i], lengths(t)[j]) < n
    out = _jaccard(_grams(s, n), _grams(t, n), i, j)
    if short.any():
        out[short] = _jaccard(_grams(s, 2), _grams(t, 2), i[short], j[short])
    return np.where(equal(s, t, i, j), 1.0, out)


def words(texts: list[str]) -> list[set]:
    return [set(x.split(" ")) - {""} for x in texts]


def token_set(s, t, i, j) -> np.ndarray:
    """As similarity.token_set_similarity."""
    return _jaccard([x - _STOP for x in words(s)], [x - _STOP for x in words(t)], i, j)


def token_cosine(s, t, i, j) -> np.ndarray:
    """As vectors.token_cosine, of all words."""
    a, b = words(s), words(t)
    m, n = shared(a, b)[i, j].astype(np.float64), np.sqrt((lengths(a)[i] * lengths(b)[j]).astype(np.float64))
    return np.divide(m, n, out=np.zeros(len(m)), where=n > 0)


def weighted(s, t, i, j, weights: dict[str, float]) -> np.ndarray:
    """As resolve.weighted_jaccard; NaN where neither label has a word. ``weights`` has all words."""
    a, b = words(s), words(t)
    m = shared(a, b, weights)[i, j]
    sums = [np.array([sum(weights[w] for w in sorted(x)) for x in sets]) for sets in (a, b)]
    n = sums[0][i] + sums[1][j] - m
    return np.divide(m, n, out=np.full(len(m), np.nan), where=n > 0)


def acronym(s, t, i, j) -> np.ndarray:
    """As similarity.acronym_bonus, of labels in lower case."""
    out, sl, tl = np.zeros(len(i)), lengths(s)[i], lengths(t)[j]
    bare = [lengths([x.replace(" ", "") for x in texts]) for texts in (s, t)]
    swap = sl <= tl
    n = np.where(swap, bare[0][i], bare[1][j])
    initials: dict[str, str] = {}
    for k in np.nonzero((n >= 2) & (n <= 8))[0].tolist():
        short, long = (s[i[k]], t[j[k]]) if swap[k] else (t[j[k]], s[i[k]])
        if " " not in long:
            continue
        if long not in initials:
            every = [w for w in long.split(" ") if w]
            telling = [w for w in every if w not in _STOP]
            initials[long] = "".join(w[0] for w in (telling if len(telling) >= 2 else every))
        short = short.replace(" ", "")
        out[k] = 1.0 if short == initials[long] else 0.8 if len(short) >= 3 and initials[long].startswith(short) else 0.0
    return out


def _coded(s: list[str], t: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """A number for each character, rows as long as the longest text; and how many numbers there are, the last for no character."""
    wide = max(1, max(map(len, s), default=1), max(map(len, t), default=1))
    raw = np.array([*s, *t], dtype=f"U{wide}").view(np.uint32).reshape(-1, wide)
    said, code = np.unique(raw, return_inverse=True)
    code = code.reshape(raw.shape)
    code[np.arange(wide) >= lengths([*s, *t])[:, None]] = len(said)
    return code[: len(s)], code[len(s) :], len(said) + 1


def _advance(s, t, i, j, begin, step, end) -> np.ndarray:
    """Runs ``step`` over the characters of t, for pairs sorted so that those with longer t go on: what ``end`` makes of the states.

    ``begin(pairs, limbs)`` gives the states, a list of arrays each limb; ``step(states, match, limbs)`` changes them in place."""
    sc, tc, kinds = _coded(s, t)
    sl, tl = lengths(s), lengths(t)
    limbs = max(1, -(-int(sl.max(initial=1)) // BITS))
    masks = np.zeros((limbs, len(s) * kinds), np.uint64)
    rows = np.arange(len(s)) * kinds
    for p in range(int(sl.max(initial=0))):
        has = sl > p
        masks[p // BITS, rows[has] + sc[has, p]] |= np.uint64(1 << p % BITS)
    by_place = np.ascontiguousarray(tc.T)
    out = np.zeros(len(i), np.int64)
    # Texts of as many limbs go together.
    order = np.lexsort((-tl[j], (sl[i] + BITS - 1) // BITS))
    need = np.maximum(1, (sl[i[order]] + BITS - 1) // BITS)
    for w in np.unique(need).tolist():
        group = order[need == w]
        for low in range(0, len(group), STEP):
            at = group[low : low + STEP]
            base, right, left_over = rows[i[at]], j[at], -tl[j[at]]
            states = begin(len(at), w)
            for k in range(int(-left_over[0])):
                n = int(np.searchsorted(left_over, -k, "left"))
                where = base[:n] + by_place[k][right[:n]]
                step(states, [masks[x].take(where) for x in range(w)], n)
            out[at] = end(states, sl[i[at]], tl[j[at]])
    return out


def common_lengths(s, t, i, j) -> np.ndarray:
    """Lengths of the longest common subsequences."""

    def begin(n, w):
        return [np.full(n, FULL) for _ in range(w)]

    def step(states, match, n):
        carry = None
        for x, m in enumerate(match):
            row = states[x][:n]
            np.bitwise_and(m, row, out=m)
            total = row + m
            if carry is not None:
                total += carry
            if x + 1 < len(match):
                carry = total >> np.uint64(BITS)
            np.bitwise_and(total, FULL, out=total)
            np.bitwise_xor(row, m, out=row)
            np.bitwise_or(row, total, out=row)

    def end(states, a, b):
        return sum(BITS - np.bitwise_count(x).astype(np.int64) for x in states)

    return _advance(s, t, i, j, begin, step, end)


def distances(s, t, i, j) -> np.ndarray:
    """Levenshtein distances (Myers, in Hyyrö's form): bits are rises and falls along s."""

    def begin(n, w):
        return [[np.full(n, FULL), np.zeros(n, np.uint64)] for _ in range(w)]

    def step(states, match, n):
        carry, up, down = np.uint64(0), ONE, np.uint64(0)
        for x, eq in enumerate(match):
            rise, fall = states[x][0][:n], states[x][1][:n]
            total = (eq & rise) + rise + carry
            carry = total >> np.uint64(BITS)
            same = (((total & FULL) ^ rise) | eq) | fall
            plus = fall | (~(same | rise) & FULL)
            minus = rise & same
            up_next, down_next = plus >> LAST, minus >> LAST
            plus = ((plus << ONE) & FULL) | up
            minus = ((minus << ONE) & FULL) | down
            up, down = up_next, down_next
            np.bitwise_or(minus, ~(same | plus) & FULL, out=rise)
            np.bitwise_and(plus, same, out=fall)

    def end(states, a, b):
        total = b.copy()
        for x, (rise, fall) in enumerate(states):
            inside = np.clip(a - x * BITS, 0, BITS).astype(np.uint64)
            mask = (ONE << inside) - ONE
            total += np.bitwise_count(rise & mask).astype(np.int64) - np.bitwise_count(fall & mask).astype(np.int64)
        return total

    return _advance(s, t, i, j, begin, step, end)


def _damped(raw: np.ndarray, short: np.ndarray) -> np.ndarray:
    return np.where((short <= 3) & (raw < 1.0), raw * 0.4, np.where((short > 3) & (short <= 5) & (raw < 0.88), raw * 0.7, raw))


def _edited(s, t, i, j, raw, apart, settings: Settings) -> np.ndarray:
    """1 where equal, 0 where empty or of lengths too far apart, else ``raw`` of the pairs that are left, damped."""
    sl, tl = lengths(s)[i], lengths(t)[j]
    short, long, same = np.minimum(sl, tl), np.maximum(sl, tl), equal(s, t, i, j)
    out, left = same.astype(np.float64), ~same & (short > 0) & ~(long > settings.length_ratio * short)
    if apart is not None:
        left &= ~(long - short > apart * long)
    if left.any():
        out[left] = _damped(raw(s, t, i[left], j[left], sl[left], tl[left]), short[left])
    return out


def levenshtein(s, t, i, j, settings: Settings = DEFAULTS) -> np.ndarray:
    """As similarity.levenshtein_similarity."""
    return _edited(s, t, i, j, lambda s, t, i, j, a, b: 1.0 - distances(s, t, i, j) / np.maximum(a, b), 0.4, settings)


def indel(s, t, i, j, settings: Settings = DEFAULTS) -> np.ndarray:
    """As similarity.indel_similarity."""
    return _edited(s, t, i, j, lambda s, t, i, j, a, b: 2.0 * common_lengths(s, t, i, j) / (a + b), None, settings)


class _Meeting:
    """Pairs of texts from which common runs are taken. ``rows`` are characters of the left texts, a column a pair, with
    no character after each; ``masks`` say for each limb, character and pair where the right text has it."""

    def __init__(self, rows, masks, left, right, common, at):
        self.rows, self.masks, self.left, self.right, self.common, self.at = rows, masks, left, right, common, at

    def of(self, which: np.ndarray) -> "_Meeting":
        """Those pairs, in no more rows and limbs than they need."""
        left, right = self.left[which], self.right[which]
        n, w = int(left.max(initial=0)) + 1, int(right.max(initial=0)) // WORD + 1
        return _Meeting(self.rows[:n].take(which, 1), self.masks[:w].take(which, 2), left, right, self.common[which], self.at[which])


def _together(some: list[_Meeting]) -> _Meeting:
    if len(some) == 1:
        return some[0]
    n, w = max(len(m.rows) for m in some), max(len(m.masks) for m in some)
    total = sum(len(m.at) for m in some)
    kinds = some[0].masks.shape[1]
    rows, masks, low = np.full((n, total), kinds - 1, np.int32), np.zeros((w, kinds, total), np.uint64), 0
    for m in some:
        here = slice(low, low + len(m.at))
        rows[: len(m.rows), here], masks[: len(m.masks), :, here] = m.rows, m.masks
        low = here.stop
    return _Meeting(rows, masks, *(np.concatenate([getattr(m, name) for m in some]) for name in ("left", "right", "common", "at")))


def _any(states: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce(states.reshape(-1, states.shape[2]), 0) != 0


def _longest(m: _Meeting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start in the left, start in the right) of each pair's longest common run, earliest in the left, then in the right; 0 where none has two characters.

    Row r has the right text's places of its character, turned by r bits: what follows on both sides lies in the same bit
    of the next row. The bit after a text's last stays free, so that no run goes from its end to its beginning."""
    w, high, n = len(m.masks), len(m.rows) - 1, len(m.left)
    where = np.multiply(m.rows[:high], n, dtype=np.int64)
    where += np.arange(n)
    found = [x.take(where, mode="clip") for x in m.masks.reshape(w, -1)]
    runs = np.empty((w, high, n), np.uint64)
    for low in range(0, high, WORD):
        here = slice(low, low + WORD)
        turn = np.arange(min(WORD, high - low), dtype=np.uint64)[:, None]
        for x in range(w):
            q = x + low // WORD
            np.right_shift(found[q % w][here], turn, out=runs[x, here])
            runs[x, here] |= found[(q + 1) % w][here] << (np.uint64(WORD) - turn)
    length, i, j = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    runs = runs[:, :-1] & runs[:, 1:]
    who, size = np.arange(n if runs.shape[1] else 0), 2
    while len(who):
        longer = runs[:, :-size] & runs[:, size:]
        more = _any(longer)
        end = np.nonzero(~more)[0]
        if len(end):
            _ended(runs if len(end) == len(who) else runs.take(end, 2), size, who[end], length, i, j)
        if len(end) == len(who):
            break
        keep = np.nonzero(more)[0]
        runs, who, size = longer if len(keep) == len(who) else longer.take(keep, 2), who[keep], 2 * size
    return length, i, j


def _ended(runs: np.ndarray, size: int, who: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """The longest runs of pairs that have some of ``size`` and none of twice that."""
    w, n = len(runs), len(who)
    total, step = np.full(n, size), size // 2
    while step:
        # Two runs that overlap are one: of the pairs that have such, only those go on.
        if step < runs.shape[1]:
            longer = runs[:, :-step] & runs[:, step:]
            more = _any(longer)
            if more.all():
                runs = longer
            elif more.any():
                np.copyto(runs[:, : longer.shape[1]], longer, where=more)
                np.copyto(runs[:, longer.shape[1] :], 0, where=more)
            total[more] += step
        step //= 2
    high = runs.shape[1]
    some = (runs[0] if w == 1 else np.bitwise_or.reduce(runs, 0)) != 0
    back = np.maximum.reduce(some * np.arange(high, 0, -1, dtype=np.int8 if high < 128 else np.int32)[:, None], 0).astype(np.int64)
    total[back == 0] = 0
    first = np.minimum(high - back, high - 1)
    bits = runs[:, first, np.arange(n)]
    # Turned back, the lowest bit is the place in the right text.
    turn, at = (first % WORD).astype(np.uint64), np.full(n, -1)
    for x in range(w):
        q = (x - first // WORD) % w
        here, below = bits[q, np.arange(n)], bits[(q - 1) % w, np.arange(n)]
        word = (here << turn) | (below >> (np.uint64(WORD) - turn))
        low = (at < 0) & (word != 0)
        at[low] = WORD * x + np.bitwise_count((word & (~word + ONE)) - ONE)[low].astype(np.int64)
    length[who], i[who], j[who] = total, first, at


def _without(m: _Meeting, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> _Meeting:
    """The pairs after their runs are taken out."""
    n, w = len(m.left), len(m.masks)
    left, right = m.left - length, m.right - length
    # Places after a run move up; those beyond the last row are cut to it, which has no characters.
    high = np.arange(int(left.max(initial=0)) + 1)[:, None]
    place = (high >= i) * (length * n)
    place += high * n + np.arange(n)
    rows = m.rows.take(place, mode="clip")
    shift = length.astype(np.uint64)
    masks = np.empty((min(w, int(right.max(initial=0)) // WORD + 1), *m.masks.shape[1:]), np.uint64)
    for x in range(len(masks)):
        moved = m.masks[x] >> shift
        for y in range(x + 1, w):
            # A shift by more than a word, which a negative one wraps to, leaves nothing.
            far = np.uint64(WORD * (y - x))
            moved |= m.masks[y] << (far - shift)
            moved |= m.masks[y] >> (shift - far)
        inside = np.clip(j - WORD * x, 0, WORD).astype(np.uint64)
        stays = np.where(inside == WORD, ~np.uint64(0), (ONE << inside) - ONE)
        # moved where nothing stays, else what was there
        other = moved ^ m.masks[x]
        other &= stays
        np.bitwise_xor(moved, other, out=masks[x])
    return _Meeting(rows, masks, left, right, m.common, m.at)


def _commons(m: _Meeting, out: np.ndarray, rounds: int = 6) -> None:
    """Into ``out`` at the pairs' places: how many characters the ``rounds`` longest runs of two or more have, each taken out before the next."""
    left = [m]
    for k in range(rounds):
        # As they shrink, pairs of as many limbs go together; those of like length in one step.
        by_size: dict[int, list[_Meeting]] = {}
        for m in left:
            size = np.maximum(m.left, m.right) // WORD
            for w in np.unique(size).tolist():
                by_size.setdefault(w, []).append(m if (size == w).all() else m.of(np.nonzero(size == w)[0]))
        left = []
        for w, some in by_size.items():
            m = _together(some)
            order, step = np.argsort(m.left, kind="stable"), max(1, CELLS // (WORD * (w + 1) ** 2))
            for low in range(0, len(order), step):
                near = m.of(order[low : low + step])
                for more in range(rounds - k - 1, -1, -1):
                    length, i, j = _longest(near)
                    near.common += length
                    out[near.at] = near.common
                    goes = np.nonzero((length > 0) & (near.left > length) & (near.right > length))[0]
                    if not more or not len(goes):
                        break
                    if len(goes) < 0.9 * len(length):
                        near, length, i, j = near.of(goes), length[goes], i[goes], j[goes]
                    near = _without(near, length, i, j)
                    # Of one limb they stay, whatever they shrink to.
                    if w:
                        left.append(near)
                        break


def _taken(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the pairs (a, b) of places in ``texts`` the characters that both have in the six longest runs; -1 where a table would take too much."""
    out = np.full(len(a), -1, np.int64)
    size = lengths(texts)
    starts = np.cumsum(size) - size
    said, code = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    kinds = len(said) + 1
    limbs = size[b] // WORD + 1
    fits = np.nonzero(np.maximum(size[a], kinds) * limbs <= MOST)[0]
    group = np.maximum(size[a] // WORD + 1, limbs)[fits]
    for w in np.unique(group).tolist():
        here = fits[group == w]
        step = max(1, NEAR // w**2)
        for low in range(0, len(here), step):
            at = here[low : low + step]
            used, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
            column, sl, tl = np.arange(len(used)), size[a[at]], size[b[at]]
            where = np.arange(int(size[used].max()) + 1)[:, None]
            rows = np.where(where < size[used], code[np.minimum(starts[used] + where, len(code) - 1)], kinds - 1).astype(np.int32)
            masks = np.zeros((int(tl.max()) // WORD + 1, kinds, len(used)), np.uint64)
            for p in range(min(len(rows), WORD * len(masks))):
                masks[p // WORD, rows[p], column] |= np.uint64(1 << p % WORD)
            masks[:, kinds - 1] = 0
            _commons(_Meeting(rows[: int(sl.max()) + 1].take(place[: len(at)], 1), masks.take(place[len(at) :], 2), sl, tl, np.zeros(len(at), np.int64), at), out)
    return out


def isub(s, t, i, j, settings: Settings = DEFAULTS) -> np.ndarray:
    """As similarity.isub_similarity."""
    texts = sorted({*s, *t})
    known = {x: n for n, x in enumerate(texts)}
    a, b = (np.array([known[x] for x in side], np.int64)[of] for side, of in ((s, i), (t, j)))
    a, b = np.minimum(a, b), np.maximum(a, b)
    size = lengths(texts)
    sl, tl = size[a], size[b]
    short, long = np.minimum(sl, tl), np.maximum(sl, tl)
    out = (a == b).astype(np.float64)
    left = np.nonzero((a != b) & (short > 0) & ~(long > settings.length_ratio * short))[0]
    if len(left):
        a, b, sl, tl = a[left], b[left], sl[left], tl[left]
        common = _taken(texts, a, b)
        score = 2.0 * common / (sl + tl) - 0.3 * ((sl - common) / sl) * ((tl - common) / tl)
        out[left] = np.where(common > 0, np.minimum(1.0, np.maximum(0.0, score)), 0.0)
        for x in np.nonzero(common < 0)[0].tolist():
            out[left[x]] = _isub(texts[a[x]], texts[b[x]], settings.length_ratio)
    return out


def exact(s, t, i, j) -> np.ndarray:
    return equal(s, t, i, j) & (lengths(s)[i] > 2)


def passes(s, t, i, j, weights: dict[str, float], settings: Settings = DEFAULTS) -> np.ndarray:
    """As resolve.lexical_gate of these scores: the cheap ones first, each of the pairs that none before it let through."""
    out = exact(s, t, i, j)
    gates = (
        (lambda i, j: token_cosine(s, t, i, j), settings.sure_semantic), (lambda i, j: token_set(s, t, i, j), settings.string_gate),
        (lambda i, j: weighted(s, t, i, j, weights), settings.overlap_gate), (lambda i, j: acronym(s, t, i, j), settings.acronym_gate),
        (lambda i, j: indel(s, t, i, j, settings), settings.string_gate), (lambda i, j: isub(s, t, i, j, settings), settings.string_gate),
    )
    for score, least in gates:
        left = np.nonzero(~out)[0]
        if len(left):
            # NaN passes no gate.
            out[left] = score(i[left], j[left]) >= least
    return out


def combined(s, t, i, j, settings: Settings = DEFAULTS) -> np.ndarray:
    """As similarity.combined_score of these scores; the structural part is the acronym's."""
    c = settings
    out, left = np.ones(len(i)), np.nonzero(~exact(s, t, i, j))[0]
    i, j = i[left], j[left]
    strings = c.ngram_weight * ngram(s, t, i, j) + c.levenshtein_weight * indel(s, t, i, j, settings) + c.isub_weight * isub(s, t, i, j, settings)
    score = c.semantic_weight * token_cosine(s, t, i, j) + c.string_weight * strings + c.structural_bonus * acronym(s, t, i, j)
    out[left] = np.minimum(1.0, np.maximum(0.0, score))
    return out
