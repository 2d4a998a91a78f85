"""A bidirectional GRU with attention pooling over character and word inputs, in numpy.

Two levels of the same layer. A word's characters run through a bidirectional
GRU whose states attention pools into one vector; beside it stands the word's
own embedding (words that the training sample holds often enough; others share
one). A window of such words runs through a second bidirectional GRU with
attention pooling, and a linear unit gives the window's logit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

WORD = re.compile(r"\w+")
#: Longer words go on as further words of the sequence.
WORD_CHARS = 24
#: Score that clean documents should stay under.
EDGE = 0.7
#: Length of the word beginnings that choose the first training windows.
PREFIX = 5
#: Characters have their own embedding below, share 64 above.
OWN_CHARS, SHARED_CHARS = 0x250, 64

Params = dict[str, np.ndarray]


def words_of(text: str) -> list[str]:
    out = WORD.findall(text.lower())
    if max(map(len, out), default=0) > WORD_CHARS:
        out = [w[i : i + WORD_CHARS] for w in out for i in range(0, len(w), WORD_CHARS)]
    return out


def window_starts(n: int, size: int, stride: int) -> list[int]:
    """Starts of all overlapping windows of ``n`` words; the last one ends with the text."""
    if n <= size:
        return [0]
    return [*range(0, n - size, stride), n - size]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def char_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (length x words, 0 past the end) and the words' lengths."""
    n = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    flat = np.where(flat < OWN_CHARS, flat, OWN_CHARS + flat % SHARED_CHARS)
    out = np.zeros((int(n.max(initial=1)), len(words)), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out[at, np.repeat(np.arange(len(words)), n)] = flat
    return out, n


def gru(xp: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States (time x rows x hidden) of a GRU over projected inputs; masked steps keep the state."""
    t_max, n, _ = xp.shape
    size = wh.shape[0]
    h = np.zeros((n, size), xp.dtype)
    out = np.empty((t_max, n, size), xp.dtype)
    saved = []
    for t in range(t_max):
        g = h @ wh
        zr = sigmoid(xp[t, :, : 2 * size] + g[:, : 2 * size])
        z, r, hn = zr[:, :size], zr[:, size:], g[:, 2 * size :]
        c = np.tanh(xp[t, :, 2 * size :] + r * hn)
        new = (c + z * (h - c) - h) * mask[t][:, None] + h
        if keep:
            saved.append((h, z, r, hn, c))
        h = out[t] = new
    return (out, saved) if keep else out


def gru_back(dout: np.ndarray, saved: list, wh: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``wh``."""
    t_max, n, size = dout.shape
    dxp, dwh = np.empty((t_max, n, 3 * size), dout.dtype), np.zeros_like(wh)
    dh = np.zeros((n, size), dout.dtype)
    for t in range(t_max - 1, -1, -1):
        h, z, r, hn, c = saved[t]
        m = mask[t][:, None]
        dh = dh + dout[t]
        dnew = dh * m
        dc = dnew * (1 - z) * (1 - c * c)
        dzr = np.concatenate([dnew * (h - c) * z * (1 - z), dc * hn * r * (1 - r)], 1)
        dg = np.concatenate([dzr, dc * r], 1)
        dxp[t] = np.concatenate([dzr, dc], 1)
        dwh += h.T @ dg
        dh = dh * (1 - m) + dnew * z + dg @ wh.T
    return dxp, dwh


def encode(p: Params, level: str, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Attention-pooled states of both directions; ``xf`` and ``xb`` are projected inputs."""
    f = gru(xf, p[f"{level}_hf"], mask, keep)
    b = gru(xb[::-1], p[f"{level}_hb"], mask[::-1], keep)
    (f, sf), (b, sb) = (f, b) if keep else ((f, None), (b, None))
    states = np.concatenate([f, b[::-1]], 2)
    a = np.tanh(states @ p[f"{level}_wa"] + p[f"{level}_ba"])
    score = np.where(mask > 0, a @ p[f"{level}_va"], -1e9).astype(xf.dtype)
    e = np.exp(score - score.max(0)) * mask
    alpha = e / np.maximum(e.sum(0), 1e-9)
    pooled = (alpha[:, :, None] * states).sum(0)
    return (pooled, (states, a, alpha, sf, sb)) if keep else pooled


def encode_back(p: Params, grads: Params, level: str, dpooled: np.ndarray, cache, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    states, a, alpha, sf, sb = cache
    size = states.shape[2] // 2
    dalpha = (states * dpooled).sum(2)
    dscore = alpha * (dalpha - (alpha * dalpha).sum(0))
    da = dscore[:, :, None] * p[f"{level}_va"] * (1 - a * a)
    flat = lambda x: x.reshape(-1, x.shape[2])
    grads[f"{level}_va"] = (a * dscore[:, :, None]).sum((0, 1))
    grads[f"{level}_wa"] = flat(states).T @ flat(da)
    grads[f"{level}_ba"] = da.sum((0, 1))
    dstates = alpha[:, :, None] * dpooled + da @ p[f"{level}_wa"].T
    dxf, grads[f"{level}_hf"] = gru_back(dstates[:, :, :size], sf, p[f"{level}_hf"], mask)
    dxb, grads[f"{level}_hb"] = gru_back(dstates[::-1, :, size:], sb, p[f"{level}_hb"], mask[::-1])
    return dxf, dxb[::-1]


@dataclass
class Model:
    params: Params
    vocabulary: dict[str, int]  # word -> row of the word embedding; 0 for all others
    window: int
    stride: int
    #: The document's score is sigmoid(scale * best window's logit + shift).
    scale: float = 1.0
    shift: float = 0.0
    cache: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def project(self, words: list[str], chunk: int = 1024) -> np.ndarray:
        """Projected inputs (words x both directions' gates) of the window level."""
        p = self.params
        out = np.empty((len(words), p["word_xf"].shape[1] * 2), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        # The first layer's products with its weights, per character.
        cf, cb = p["chars"] @ p["char_xf"] + p["char_bf"], p["chars"] @ p["char_xb"] + p["char_bb"]
        for i in range(0, len(order), chunk):
            some = order[i : i + chunk]
            codes, n = char_codes([words[j] for j in some])
            mask = (np.arange(len(codes))[:, None] < n).astype(np.float32)
            pooled = encode(p, "char", cf[codes], cb[codes], mask)
            known = p["words"][[self.vocabulary.get(words[j], 0) for j in some]]
            x = np.concatenate([pooled, known], 1)
            out[some] = np.concatenate([x @ p["word_xf"] + p["word_bf"], x @ p["word_xb"] + p["word_bb"]], 1)
        return out

    def window_logits(self, projected: np.ndarray, index: np.ndarray, chunk: int = 512) -> np.ndarray:
        """Logits of windows; ``index`` (windows x size) holds rows of ``projected``, -1 past the end."""
        p, half = self.params, projected.shape[1] // 2
        out = np.empty(len(index), np.float32)
        for i in range(0, len(index), chunk):
            at = index[i : i + chunk].T
            x = projected[np.maximum(at, 0)]
            pooled = encode(p, "word", x[:, :, :half], x[:, :, half:], (at >= 0).astype(np.float32))
            out[i : i + chunk] = pooled @ p["out"] + p["out_b"]
        return out

    def best_logits(self, texts: list[list[str]]) -> np.ndarray:
        """For each sequence of words the highest logit of its overlapping windows."""
        number: dict[str, int] = {}
        ids = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in texts]
        projected = self.project(list(number)) if number else np.zeros((1, 2 * self.params["word_xf"].shape[1]), np.float32)
        rows, starts = [], []
        for x in ids:
            starts.append(len(rows))
            for s in window_starts(len(x), self.window, self.stride):
                w = x[s : s + self.window]
                rows.append(w if len(w) == self.window else np.concatenate([w, np.full(self.window - len(w), -1)]))
        return np.maximum.reduceat(self.window_logits(projected, np.array(rows, np.int64)), starts)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        x = np.clip(self.scale * self.best_logits(texts).astype(np.float64) + self.shift, -40, 40)
        return sigmoid(x)


def new_params(vocabulary: int, rng: np.random.Generator, chars: int = 12, words: int = 8, char_hidden: int = 10, word_hidden: int = 8, attention: int = 8) -> Params:
    def w(*shape, scale=None):
        return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

    p = {"chars": w(OWN_CHARS + SHARED_CHARS, chars, scale=0.5), "words": w(vocabulary, words, scale=0.1)}
    for level, size, hidden in (("char", chars, char_hidden), ("word", 2 * char_hidden + words, word_hidden)):
        for d in "fb":
            p[f"{level}_x{d}"], p[f"{level}_h{d}"] = w(size, 3 * hidden), w(hidden, 3 * hidden)
            p[f"{level}_b{d}"] = np.zeros(3 * hidden, np.float32)
        p[f"{level}_wa"], p[f"{level}_ba"], p[f"{level}_va"] = w(2 * hidden, attention), np.zeros(attention, np.float32), w(attention)
    p["out"], p["out_b"] = w(2 * word_hidden), np.zeros((), np.float32)
    return p


def loss_and_grads(p: Params, vocabulary: dict[str, int], windows: list[list[str]], label: np.ndarray) -> tuple[float, Params]:
    """Mean logistic loss of a batch of windows and the gradients of all parameters."""
    g: Params = {}
    kind = p["chars"].dtype
    number: dict[str, int] = {}
    size = max(1, max(map(len, windows)))
    at = np.full((size, len(windows)), -1, np.int64)
    for i, w in enumerate(windows):
        at[: len(w), i] = [number.setdefault(x, len(number)) for x in w]
    distinct = list(number) or [""]
    codes, n = char_codes(distinct)
    cmask = (np.arange(len(codes))[:, None] < n).astype(kind)
    emb = p["chars"][codes]
    pooled, ccache = encode(p, "char", emb @ p["char_xf"] + p["char_bf"], emb @ p["char_xb"] + p["char_bb"], cmask, True)
    rows = np.array([vocabulary.get(w, 0) for w in distinct])
    x = np.concatenate([pooled, p["words"][rows]], 1)
    here, wmask = np.maximum(at, 0), (at >= 0).astype(kind)
    xf, xb = x @ p["word_xf"] + p["word_bf"], x @ p["word_xb"] + p["word_bb"]
    vec, wcache = encode(p, "word", xf[here], xb[here], wmask, True)
    logit = vec @ p["out"] + p["out_b"]
    loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
    d = ((sigmoid(logit) - label) / len(label)).astype(kind)
    g["out"], g["out_b"] = vec.T @ d, d.sum()
    dxf, dxb = encode_back(p, g, "word", d[:, None] * p["out"], wcache, wmask)
    dx = np.zeros_like(x)
    for name, grad in (("f", dxf), ("b", dxb)):
        per = np.zeros((len(distinct), grad.shape[2]), kind)
        np.add.at(per, here.reshape(-1), (grad * wmask[:, :, None]).reshape(-1, grad.shape[2]))
        g[f"word_x{name}"], g[f"word_b{name}"] = x.T @ per, per.sum(0)
        dx += per @ p[f"word_x{name}"].T
    width = pooled.shape[1]
    g["words"] = np.zeros_like(p["words"])
    np.add.at(g["words"], rows, dx[:, width:])
    dcf, dcb = encode_back(p, g, "char", dx[:, :width], ccache, cmask)
    demb = np.zeros_like(emb)
    for name, grad in (("f", dcf), ("b", dcb)):
        grad = grad * cmask[:, :, None]
        flat = grad.reshape(-1, grad.shape[2])
        g[f"char_x{name}"], g[f"char_b{name}"] = emb.reshape(-1, emb.shape[2]).T @ flat, flat.sum(0)
        demb += grad @ p[f"char_x{name}"].T
    g["chars"] = np.zeros_like(p["chars"])
    np.add.at(g["chars"], codes.reshape(-1), demb.reshape(-1, demb.shape[2]))
    return loss, g


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, g: Params, decay: float = 0.0, clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        s = min(1.0, clip / (norm + 1e-9))
        for k, x in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * s * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * (s * x) ** 2
            move = self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            self.p[k] = ((1 - decay) * self.p[k] - move).astype(self.p[k].dtype)


def train(
    bags: list[list[list[str]]], label: np.ndarray, window: int, stride: int, seed: int = 7, steps: int = 500, batch: int = 64,
    rate: float = 0.01, vocabulary: int = 4096, least: int = 4, clean_weight: float = 1.0, dropped: float = 0.2, decay: float = 1e-4,
) -> Model:
    """Fit to documents given as bags of windows (lists of words).

    Batches hold as many toxic as clean documents, each with its highest window
    (the one that decides) or, by turns, a random one. At first highest means
    by the log odds of its words and word beginnings in the two classes, which
    the word embeddings also start from; later by the model's own score, looked
    up four times. A
    share ``dropped`` of each window's words is left out, so that a few rare
    words cannot stand for a document. A
    fifth of the documents is left out of the fit and sets scale and shift of
    the score; there a clean document counts ``clean_weight`` times, which
    restores the classes' shares in the corpus.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    aside = order[: len(bags) // 5] if len(bags) >= 50 else order[:0]
    fit = np.setdiff1d(order, aside)
    seen: dict[str, int] = {}
    for i in fit:
        for w in {x for win in bags[i] for x in win}:
            seen[w] = seen.get(w, 0) + 1
    common = sorted((w for w, c in seen.items() if c >= least), key=lambda w: (-seen[w], w))[: vocabulary - 1]
    model = Model(new_params(len(common) + 1, rng), {w: i + 1 for i, w in enumerate(common)}, window, stride)
    odds = _log_odds([bags[i] for i in fit], label[fit])
    for w, i in model.vocabulary.items():
        model.params["words"][i, 0] = odds.get(w, 0.0) / 2
    adam = Adam(model.params, rate)
    top = {i: int(np.argmax([sum(max(0.0, odds.get(x, 0.0), odds.get(x[:PREFIX] + "*", 0.0)) for x in w) for w in bags[i]])) for i in fit.tolist()}
    classes = [fit[label[fit] == y] for y in (0, 1)]
    queues: list[list[int]] = [[], []]
    for step in range(steps):
        if step in {steps * k // 6 for k in (2, 3, 4, 5)}:
            top = dict(zip(fit.tolist(), _top_windows(model, [bags[i] for i in fit])))
        adam.rate = rate * min(1.0, (step + 1) / 20) * (1.0 if step < steps * 2 // 3 else 0.3)
        part, labels = [], []
        for y in (0, 1):
            for k in range(batch // 2):
                if not queues[y]:
                    queues[y] = rng.permutation(classes[y]).tolist()
                i = queues[y].pop()
                hard = k % 4 < 3 if y == 1 else k % 2 == 0
                words = bags[i][top[i] if hard else int(rng.integers(len(bags[i])))]
                part.append([w for w, u in zip(words, rng.random(len(words))) if u >= dropped])
                labels.append(y)
        _, g = loss_and_grads(model.params, model.vocabulary, part, np.array(labels, np.float32))
        adam.step(g, decay)
    if len(aside) and 0 < label[aside].sum() < len(aside):
        logits = np.array([_bag_logit(model, bags[i]) for i in aside])
        model.scale, model.shift = calibrate(logits, label[aside], np.where(label[aside] > 0, 1.0, clean_weight))
        # Few labels make a weak model; then rather miss than reject: of the clean documents
        # left out, one in 200 at most may reach EDGE.
        clean = np.quantile(logits[label[aside] == 0], 0.995)
        model.shift = min(model.shift, float(np.log(EDGE / (1 - EDGE)) - model.scale * clean))
    return model


def _log_odds(bags: list[list[list[str]]], label: np.ndarray) -> dict[str, float]:
    """Smoothed log odds of each word, and of each beginning (marked ``*``), over the documents that hold it."""
    seen: list[dict[str, int]] = [{}, {}]
    for bag, y in zip(bags, label):
        words = {x for w in bag for x in w}
        for x in words | {x[:PREFIX] + "*" for x in words if len(x) > PREFIX}:
            seen[int(y)][x] = seen[int(y)].get(x, 0) + 1
    n = max(1, int((label == 0).sum())), max(1, int((label > 0).sum()))
    return {
        x: float(np.log((c + 0.5) / (n[1] + 1)) - np.log((seen[0].get(x, 0) + 0.5) / (n[0] + 1)))
        for x, c in seen[1].items() if c >= 3
    }


def _top_windows(model: Model, bags: list[list[list[str]]]) -> list[int]:
    out = []
    for s in range(0, len(bags), 256):
        part = bags[s : s + 256]
        flat = [w for b in part for w in b]
        number: dict[str, int] = {}
        index = np.full((len(flat), model.window), -1, np.int64)
        for i, w in enumerate(flat):
            index[i, : len(w)] = [number.setdefault(x, len(number)) for x in w]
        logits = model.window_logits(model.project(list(number) or [""]), index)
        at = np.cumsum([0, *[len(b) for b in part]])
        out += [int(logits[a:b].argmax()) for a, b in zip(at[:-1], at[1:])]
    return out


def _bag_logit(model: Model, bag: list[list[str]]) -> float:
    number: dict[str, int] = {}
    index = np.full((len(bag), model.window), -1, np.int64)
    for i, w in enumerate(bag):
        index[i, : len(w)] = [number.setdefault(x, len(number)) for x in w]
    return float(model.window_logits(model.project(list(number) or [""]), index).max())


def calibrate(logit: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift of a logistic fit (Newton's method, a small ridge towards 1 and 0)."""
    a, b, ridge = 1.0, 0.0, 1.0
    for _ in range(rounds):
        q = sigmoid(np.clip(a * logit + b, -40, 40))
        d = weight * (q - label)
        g = np.array([(d * logit).sum() + ridge * (a - 1), d.sum() + ridge * b])
        w = weight * q * (1 - q)
        h = np.array([[(w * logit * logit).sum() + ridge, (w * logit).sum()], [(w * logit).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)
