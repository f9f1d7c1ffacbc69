"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Small enough to train on the driver in seconds: sequences of one fixed length,
one label per character, loss by the forward-backward algorithm, Adam updates.
A trained model is a dict of arrays, so it can be broadcast as it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Model = dict[str, np.ndarray]

#: Code 0 stands for any character outside printable ASCII.
N_CODES = 97


def encode(text: str) -> np.ndarray:
    """One code per character: printable ASCII has its own, tabs and line ends count as spaces."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where((points >= 32) & (points < 127), points.astype(np.int64) - 31, np.where((points >= 9) & (points <= 13), 1, 0)).astype(np.int64)


def fresh(n_labels: int, seed: int, embedding: int = 10, hidden: int = 12) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
    model = {"E": draw(N_CODES, embedding), "Wo": draw(2 * hidden, n_labels), "bo": np.zeros(n_labels, np.float32), "T": np.zeros((n_labels, n_labels), np.float32), "S": np.zeros(n_labels, np.float32)}
    for side in "fb":
        model |= {f"Wx{side}": draw(embedding, 4 * hidden), f"Wh{side}": draw(hidden, 4 * hidden), f"b{side}": np.repeat(np.float32([0, 1, 0, 0]), hidden)}
    return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states (time, rows, hidden) of inputs (time, rows, embedding); gates are in, forget, out, new."""
    steps, rows, hidden = len(x), x.shape[1], wh.shape[0]
    drive = x @ wx + b
    hs, cs = np.zeros((steps + 1, rows, hidden), np.float32), np.zeros((steps + 1, rows, hidden), np.float32)
    gates = np.empty((steps, rows, 4 * hidden), np.float32)
    for t in range(steps):
        z = drive[t] + hs[t] @ wh
        g = gates[t]
        g[:, : 3 * hidden] = _sigmoid(z[:, : 3 * hidden])
        g[:, 3 * hidden :] = np.tanh(z[:, 3 * hidden :])
        i, f, o, n = np.split(g, 4, axis=1)
        cs[t + 1] = f * cs[t] + i * n
        hs[t + 1] = o * np.tanh(cs[t + 1])
    return hs[1:], (x, hs, cs, gates)


def _lstm_back(dh_out: np.ndarray, kept: tuple, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, ...]:
    x, hs, cs, gates = kept
    steps, rows, hidden = dh_out.shape
    dz = np.empty((steps, rows, 4 * hidden), np.float32)
    dh, dc = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, n = np.split(gates[t], 4, axis=1)
        squashed = np.tanh(cs[t + 1])
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz[t] = np.concatenate([dc * n * i * (1 - i), dc * cs[t] * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - n**2)], axis=1)
        dh, dc = dz[t] @ wh.T, dc * f
    flat = dz.reshape(-1, 4 * hidden)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, hs[:-1].reshape(-1, hidden).T @ flat, flat.sum(axis=0)


def emissions(model: Model, codes: np.ndarray, keep: bool = False):
    """Label scores (rows, time, labels) of code windows (rows, time)."""
    x = model["E"][codes.T]
    hf, kf = _lstm(x, model["Wxf"], model["Whf"], model["bf"])
    hb, kb = _lstm(x[::-1], model["Wxb"], model["Whb"], model["bb"])
    h = np.concatenate([hf, hb[::-1]], axis=2)
    scores = (h @ model["Wo"] + model["bo"]).transpose(1, 0, 2)
    return (scores, (codes, h, kf, kb)) if keep else scores


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _loss_and_gradient(model: Model, codes: np.ndarray, labels: np.ndarray) -> tuple[float, Model]:
    scores, (_, h, kf, kb) = emissions(model, codes, keep=True)
    rows, steps, n = scores.shape
    trans, start = model["T"], model["S"]
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = start + scores[:, 0]
    for t in range(1, steps):
        alpha[:, t] = scores[:, t] + _logsum(alpha[:, t - 1, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[:, t] = _logsum(trans + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _logsum(alpha[:, -1], 1)
    gold = np.eye(n, dtype=np.float32)[labels]
    right = start[labels[:, 0]] + (scores * gold).sum(axis=(1, 2)) + trans[labels[:, :-1], labels[:, 1:]].sum(axis=1)
    d_scores = (np.exp(alpha + beta - total[:, None, None]) - gold) / rows
    pair = np.exp(alpha[:, :-1, :, None] + trans + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
    np.subtract.at(pair, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    d_time = d_scores.transpose(1, 0, 2)
    d_h = d_time @ model["Wo"].T
    hidden = d_h.shape[2] // 2
    dxf, *gf = _lstm_back(d_h[:, :, :hidden], kf, model["Wxf"], model["Whf"])
    dxb, *gb = _lstm_back(d_h[::-1, :, hidden:], kb, model["Wxb"], model["Whb"])
    d_e = np.zeros_like(model["E"])
    np.add.at(d_e, codes.T, dxf + dxb[::-1])
    gradient = {"E": d_e, "Wo": h.reshape(-1, 2 * hidden).T @ d_time.reshape(-1, n), "bo": d_scores.sum(axis=(0, 1)), "T": pair / rows, "S": d_scores[:, 0].sum(axis=0)}
    gradient |= dict(zip(("Wxf", "Whf", "bf"), gf, strict=True)) | dict(zip(("Wxb", "Whb", "bb"), gb, strict=True))
    return float((total - right).mean()), gradient


def train(codes: np.ndarray, labels: np.ndarray, n_labels: int, steps: int, seed: int, batch: int = 48, rate: float = 0.02) -> Model:
    """A model fitted to windows ``codes`` with ``labels`` (both rows x time) by Adam."""
    model, rng = fresh(n_labels, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for k in range(1, steps + 1):
        pick = rng.integers(0, len(codes), batch)
        _, gradient = _loss_and_gradient(model, codes[pick], labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
        pace = rate * min(1.0, 2 * (1 - k / (steps + 1)))
        for name, g in gradient.items():
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            model[name] = (model[name] - pace * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return model


def viterbi(model: Model, scores: np.ndarray, lengths: np.ndarray, start: np.ndarray | None = None, last: np.ndarray | None = None) -> list[np.ndarray]:
    """Best label sequence of each row of ``scores`` (rows, time, labels) over its length; ``start`` (rows, labels) and ``last`` (rows) bind its ends."""
    rows, steps, n = scores.shape
    # Sums of many steps in double precision, or labels of long rows turn on their rounding.
    best = np.float64(model["S"] if start is None else start) + scores[:, 0]
    came = np.zeros((rows, steps, n), np.int8)
    ends = [best]
    for t in range(1, steps):
        ways = best[:, :, None] + model["T"]
        came[:, t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + scores[:, t]
        ends.append(best)
    out = []
    for r, size in enumerate(lengths):
        path = np.empty(size, np.int64)
        path[-1] = ends[size - 1][r].argmax() if last is None else last[r]
        for t in range(size - 1, 0, -1):
            path[t - 1] = came[r, t, path[t]]
        out.append(path)
    return out


def viterbi_in_pieces(model: Model, scores_of: Callable[[int, int], np.ndarray], size: int, piece: int, at_once: int = 128) -> np.ndarray:
    """Best label sequence of one long row, whose scores (time, labels) ``scores_of(start, end)`` gives.

    The sequence is that of a single decoding, at the memory of ``at_once`` pieces: first the best way through every
    piece from each label before it to each label at its end, then the best way over all pieces, then the labels inside.
    """
    trans, whole = model["T"], size // piece
    blocks = [(k * piece, min(at_once, whole - k), piece) for k in range(0, whole, at_once)]
    blocks += [(whole * piece, 1, size % piece)] if size % piece else []

    def begun(at: int, before: np.ndarray) -> np.ndarray:
        start = trans[before]
        if at == 0:
            start[0] = model["S"]
        return start

    total, back = np.zeros(len(trans)), []
    for at, n, steps in blocks:
        scores = scores_of(at, at + n * steps).reshape(n, steps, -1)
        best = np.float64(begun(at, np.tile(np.arange(len(trans)), (n, 1)))) + scores[:, :1]
        for t in range(1, steps):
            best = (best[..., None] + trans).max(axis=2) + scores[:, t, None]
        for ways in best:
            through = total[:, None] + ways
            back.append(through.argmax(axis=0))
            total = through.max(axis=0) - through.max()
    last = np.full(len(back), total.argmax())
    for k in range(len(back) - 1, 0, -1):
        last[k - 1] = back[k][last[k]]
    out, before, k = np.empty(size, np.int8), np.append(0, last), 0
    for at, n, steps in blocks:
        scores = scores_of(at, at + n * steps).reshape(n, steps, -1)
        paths = viterbi(model, scores, np.full(n, steps), begun(at, before[k : k + n]), last[k : k + n])
        out[at : at + n * steps] = np.concatenate(paths)
        k += n
    return out
