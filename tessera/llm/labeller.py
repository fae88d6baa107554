"""A recurrent labeller of a page's lines: features, a numpy bidirectional LSTM, its training."""

from __future__ import annotations

import re

import numpy as np

from .chargrid import LETTER, NUMBER, SPACE, classes, join, lowered, mix, run_starts, span_hashes

#: Buckets of hashed words for the corpus contrast and for the learnt word vectors.
CONTRAST_BITS, WORD_BITS = 17, 13
WORD_DIM, HIDDEN = 16, 24
BULLETS = [ord(c) for c in "✓•*-–—#·▪►"]
MARKS = [ord(c) for c in "·›>|/»"]
N_PATH = 27


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: code points, starts of texts, starts of lower-cased letter words, hashes of these."""
    cps, ends = join(texts)
    if not len(cps):
        return cps, ends, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = classes()[cps]
    letters = kind == LETTER
    first = run_starts(letters.view(np.uint8), ends)
    lo = np.flatnonzero(first & letters)
    stop = np.append(np.flatnonzero(first), len(cps))
    hi = stop[np.searchsorted(stop, lo, "right")]
    return cps, ends, lo, span_hashes(lowered()[cps], lo, hi)


#: What lines are counted without: bullets before, a colon or full stop behind, figures.
EDGES, DIGITS = re.compile(r"^[\s✓•*–—#·▪►>-]+|[\s:.]+$"), re.compile(r"\d+")


def line_keys(texts: list[str]) -> np.ndarray:
    """A hash of each line as lines are counted: in lower case, without EDGES, figures alike."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(DIGITS.sub("0", EDGES.sub("", x.lower()))) for x in texts), np.uint64, len(texts))


class Lines:
    """The lines of a few pages: which are not blank, their words, and what is seen of each line's form (its path)."""

    def __init__(self, pages: list[str], titles: list[str], contrast: np.ndarray):
        lines = [p.split("\n") for p in pages]
        flat = [x for p in lines for x in p]
        page = np.repeat(np.arange(len(pages)), [len(p) for p in lines])
        number = np.concatenate([np.arange(1, len(p) + 1) for p in lines]) if lines else np.zeros(0, np.int64)
        stripped = [x.strip() for x in flat]
        full = np.fromiter(map(bool, stripped), bool, len(stripped))
        keep = np.flatnonzero(full)
        self.page, self.number = page[keep], number[keep]
        self.text = [stripped[i] for i in keep]
        self.sizes = np.bincount(self.page, minlength=len(pages))
        cps, ends, lo, h = words_of(self.text)
        owner = np.searchsorted(ends, lo, "right") - 1
        self.first_word = np.searchsorted(owner, np.arange(len(self.text) + 1))
        self.buckets = (h >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        self.path = self._path(flat, keep, full, page, titles, cps, ends, contrast[(h >> np.uint64(64 - CONTRAST_BITS)).astype(np.int64)])

    def _sum(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        run = np.append(0, np.cumsum(values, dtype=np.float64))
        return run[ends[1:]] - run[ends[:-1]]

    def _path(self, flat, keep, full, page, titles, cps, ends, contrast) -> np.ndarray:
        n = len(self.text)
        out = np.zeros((n, N_PATH), np.float32)
        if not n:
            return out
        kind = classes()[cps]
        length = np.diff(ends)
        words = np.diff(self.first_word)
        start, last = cps[ends[:-1]], cps[ends[1:] - 1]
        upper = (kind == LETTER) & (lowered()[cps] != cps)
        known = np.isfinite(contrast)
        w_ends = self.first_word
        total, count = self._sum(np.where(known, contrast, 0), w_ends), self._sum(known, w_ends)
        most = np.full(n, -1.0)
        owner = np.repeat(np.arange(n), words)
        np.maximum.at(most, owner[known], contrast[known])
        previous, following = np.append(False, full[:-1]), np.append(full[1:], False)
        order = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        size = np.repeat(self.sizes, self.sizes)
        longest = np.zeros(len(self.sizes))
        np.maximum.at(longest, self.page, length)
        titled = [(t or "").strip().lower() for t in titles]
        same = np.zeros((n, 3), np.float32)
        seen: set[tuple[int, str]] = set()
        for i, (p, x) in enumerate(zip(self.page.tolist(), self.text)):
            t, x = titled[p], x.lower()
            if t and t in x:
                same[i, 0 if len(x) == len(t) else 1] = 1
            if (p, x) in seen:
                same[i, 2] = 1
            else:
                seen.add((p, x))
        indent = np.fromiter((len(flat[i]) - len(flat[i].lstrip()) for i in keep), np.float32, n)
        columns = [
            np.log1p(length) / 5, np.minimum(indent, 4) / 4, np.isin(start, BULLETS), last == ord(":"), np.isin(last, [ord(c) for c in ".!?"]),
            np.minimum(self._sum(np.isin(cps, MARKS), ends), 6) / 3, self._sum(kind == NUMBER, ends) / length, self._sum(upper, ends) / length,
            np.minimum(words, 30) / 15, words == 1, words == 0, self._sum(np.isin(cps, [ord(c) for c in "$€£₹"]), ends) > 0, self._sum(cps == 169, ends) > 0,
            same[:, 0], same[:, 1], same[:, 2], ~previous[keep], ~following[keep], order / np.maximum(size, 1), np.minimum(order, 20) / 20,
            np.minimum(size - 1 - order, 20) / 20, total / np.maximum(count, 1), most / 3, np.minimum(count, 10) / 10, self._sum(kind == SPACE, ends) / length,
            length / np.maximum(longest, 1)[self.page], (kind[ends[:-1]] == LETTER) & (lowered()[start] == start),
        ]
        for k, c in enumerate(columns):
            out[:, k] = c
        return out


def contrast_table(scraped: np.ndarray, other: np.ndarray, n_scraped: int, n_other: int, least: int = 8) -> np.ndarray:
    """How much more often the words of a bucket stand in scraped records than in others, as a logarithm; not a number
    where too few records have one."""
    ratio = np.log((scraped + 1) / max(1, n_scraped)) - np.log((other + 1) / max(1, n_other))
    return np.where(scraped + other >= least, ratio, np.nan).astype(np.float32)


def weak_labels(lines: Lines, own: np.ndarray, other: np.ndarray, titles: np.ndarray, n_pages: int, n_other: int) -> np.ndarray:
    """1 for lines that surely belong to the posting, 0 for lines that surely don't, -1 for the rest.

    own and other say how many of the n_pages pages, and of the n_other records that hold a posting alone, have a line,
    titles how many titles these pages have. A line of the page around a posting stands on pages of many titles and hardly
    in a record of the other kind; a posting's stands
    in as large a share of both, or, being long, on hardly any other page. Without records of the other kind, what many
    pages repeat is the page's. Lines between are labelled if the sure lines on both sides agree."""
    f = lines.path
    words = np.diff(lines.first_word)
    out = np.full(len(f), -1, np.int8)
    if n_other:
        expected = own * (n_other / max(1, n_pages))
        out[(other >= np.maximum(1, 0.3 * expected)) & (words >= 4)] = 1
        out[(titles >= 10) & (expected >= 5) & (other <= 0.1 * expected)] = 0
    else:
        out[(titles >= 10) & (own >= 0.01 * n_pages)] = 0
    out[(out == 0) & (f[:, 26] > 0)] = -1  # a line that begins small goes on from the one before
    out[(own <= 2) & (words >= 8) & (out < 0)] = 1
    # What lines alone don't tell their words may: those far more frequent in pages than in other records.
    mean, most, count = f[:, 21], f[:, 22] * 3, f[:, 23] * 10
    out[(out < 0) & (most > 1.6) & (mean > np.where(count <= 4, 0.45, 0.7))] = 0
    out[(out < 0) & ((count >= 4) & (mean < 0.25) & (most < 1.5) | (count >= 1) & (mean < 0.3) & (most < 0.75))] = 1
    out[(f[:, 12] > 0) | (f[:, 5] >= 0.9)] = 0
    titles = np.bincount(lines.page[f[:, 13] > 0], minlength=int(lines.page.max()) + 1 if len(f) else 0)
    own = f[:, 13] > 0
    out[own] = np.where(titles[lines.page[own]] == 1, 1, -1)
    out[(f[:, 14] > 0) & (f[:, 5] > 0)] = 0
    # Headings that navigation uses, too: a run of them after a line of the page, and before another or the posting's own
    # heading.
    short = ((words <= 3) & (f[:, 2] == 0) & (f[:, 4] == 0) & ~own & (out != 0)).tolist()
    page, i = lines.page.tolist(), 0
    while i < len(f):
        j = i + 1
        if short[i]:
            while j < len(f) and short[j] and page[j] == page[i]:
                j += 1
            before = i == 0 or page[i - 1] != page[i] or out[i - 1] == 0
            after = j == len(f) or page[j] != page[i] or out[j] == 0 or own[j]
            if before and after:
                out[i:j] = 0
        i = j
    sure = out.copy()
    at = np.flatnonzero(sure >= 0)
    for i in np.flatnonzero(sure < 0):
        k = np.searchsorted(at, i)
        near = [at[j] for j in (k - 1, k) if 0 <= j < len(at) and lines.page[at[j]] == lines.page[i] and abs(int(at[j]) - int(i)) <= 3]
        if len(near) == 2 and sure[near[0]] == sure[near[1]]:
            out[i] = sure[near[0]]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = N_PATH + WORD_DIM
    m = {"words": rng.normal(0, 0.1, (1 << WORD_BITS, WORD_DIM)), "out": rng.normal(0, 0.2, (2 * HIDDEN + d, 1)), "out_b": np.zeros(1)}
    for side in "fb":
        m[f"w{side}"] = rng.normal(0, 1 / np.sqrt(d + HIDDEN), (d + HIDDEN, 4 * HIDDEN))
        m[f"c{side}"] = np.zeros(4 * HIDDEN)
        m[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1
    return {k: v.astype(np.float32) for k, v in m.items()}


def line_vectors(m: dict, lines: Lines) -> np.ndarray:
    """Path features and the mean of the hashed words' vectors."""
    n = np.diff(lines.first_word)
    run = np.zeros((len(lines.buckets) + 1, WORD_DIM), np.float64)
    np.cumsum(m["words"][lines.buckets], axis=0, out=run[1:])
    mean = (run[lines.first_word[1:]] - run[lines.first_word[:-1]]) / np.maximum(n, 1)[:, None]
    return np.concatenate([lines.path, mean.astype(np.float32)], axis=1)


def padded(sizes: np.ndarray, most: int):
    """Batches of pages of about one length: (pages, index matrix step x page into lines, -1 where a page has ended)."""
    start = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * sizes[order[hi]] <= most:
            hi += 1
        pages = order[lo:hi]
        step = np.arange(sizes[pages].max())[:, None]
        yield np.where(step < sizes[pages], start[pages] + step, -1)
        lo = hi


def _lstm(x: np.ndarray, there: np.ndarray, w: np.ndarray, b: np.ndarray, back: bool, keep: list | None):
    steps, pages, d = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((steps, pages, HIDDEN), np.float32)
    pre = (x.reshape(-1, d) @ w[:d] + b).reshape(steps, pages, -1)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        z = pre[t] + h @ w[d:]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = there[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc, m))
        c, h = c_new * m, o * tc * m  # before a page's end (read backwards) the state stays empty
        out[t] = h
    return out


def _lstm_back(dout, x, w, keep):
    steps, pages, d = x.shape
    dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), np.zeros_like(x)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t, h, c, i, f, o, g, tc, m in reversed(keep):
        dh = (dh + dout[t]) * m
        dc = dc * m
        dct = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
        dw[:d] += x[t].T @ dz
        dw[d:] += h.T @ dz
        db += dz.sum(0)
        dx[t] = dz @ w[:d].T
        dh, dc = dz @ w[d:].T, dct * f
    return dw, db, dx


def scores(m: dict, lines: Lines, most: int = 16_384) -> np.ndarray:
    """The probability of each line to belong to the posting, with the whole page in view."""
    v = line_vectors(m, lines)
    out = np.zeros(len(v), np.float32)
    for at in padded(lines.sizes, most):
        there = (at >= 0).astype(np.float32)
        x = v[at] * there[:, :, None]
        h = np.concatenate([_lstm(x, there, m["wf"], m["cf"], False, None), _lstm(x, there, m["wb"], m["cb"], True, None), x], axis=2)
        out[at[at >= 0]] = _sigmoid(h @ m["out"] + m["out_b"])[:, :, 0][at >= 0]
    return out


def train(lines: Lines, labels: np.ndarray, epochs: int = 8, least_steps: int = 320, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """A model fitted to labels of 0 and 1 (-1 is left out) by Adam over batches of pages, with a rate falling to 0."""
    m = new_model(seed)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    batches, rng, step = list(padded(lines.sizes, 2048)), np.random.default_rng(seed), 0
    n_words = np.maximum(np.diff(lines.first_word), 1)
    epochs = max(epochs, -(-least_steps // max(1, len(batches))))
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            at = batches[b]
            there = (at >= 0).astype(np.float32)
            own = at[at >= 0]
            many = lines.first_word[own + 1] - lines.first_word[own]
            ends = np.append(0, np.cumsum(many))
            buckets = lines.buckets[np.repeat(lines.first_word[own] - ends[:-1], many) + np.arange(ends[-1])]
            run = np.zeros((len(buckets) + 1, WORD_DIM))
            np.cumsum(m["words"][buckets], axis=0, out=run[1:])
            vec = (run[ends[1:]] - run[ends[:-1]]).astype(np.float32)
            x = np.zeros((*at.shape, N_PATH + WORD_DIM), np.float32)
            x[at >= 0] = np.concatenate([lines.path[own], vec / n_words[own][:, None]], axis=1)
            drop = (rng.random((*at.shape, 1)) > 0.25).astype(np.float32)  # so that it can't lean on the contrast alone
            x[:, :, 21:24] *= drop
            kf, kb = [], []
            hf, hb = _lstm(x, there, m["wf"], m["cf"], False, kf), _lstm(x, there, m["wb"], m["cb"], True, kb)
            h = np.concatenate([hf, hb, x], axis=2)
            p = _sigmoid(h @ m["out"] + m["out_b"])[:, :, 0]
            y = np.where(at >= 0, labels[at], -1)
            dz = np.where(y >= 0, p - y, 0).astype(np.float32)[:, :, None] / max(1, (y >= 0).sum())
            g = {"out": h.reshape(-1, h.shape[2]).T @ dz.reshape(-1, 1), "out_b": dz.sum((0, 1))}
            dh = dz @ m["out"].T
            g["wf"], g["cf"], dx1 = _lstm_back(dh[:, :, :HIDDEN], x, m["wf"], kf)
            g["wb"], g["cb"], dx2 = _lstm_back(dh[:, :, HIDDEN : 2 * HIDDEN], x, m["wb"], kb)
            dvec = np.repeat((dx1 + dx2 + dh[:, :, 2 * HIDDEN :])[at >= 0][:, N_PATH:] / n_words[own][:, None], many, axis=0)
            g["words"] = np.zeros_like(m["words"])
            if len(buckets):
                order = np.argsort(buckets, kind="stable")
                first_of = np.flatnonzero(np.diff(buckets[order], prepend=-1))
                g["words"][buckets[order][first_of]] = np.add.reduceat(dvec[order], first_of, axis=0)
            step += 1
            for k, d in g.items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d * d - second[k])
                m[k] -= rate * (1 - step / (epochs * len(batches) + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m
