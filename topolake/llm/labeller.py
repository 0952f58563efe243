"""A bidirectional LSTM in numpy that labels each block of a page as text of the article or not."""

from __future__ import annotations

import numpy as np

from .blocks import PATH_BUCKETS, STATS, WORD_BUCKETS

INPUT, HIDDEN = 24, 16


def new(seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters: embeddings of path buckets, words and statistics into an input vector, two LSTMs, and the output."""
    r = np.random.default_rng(seed)
    at = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
    out = {"path": r.normal(0, 0.1, (PATH_BUCKETS, INPUT)), "word": at(WORD_BUCKETS, INPUT), "stat": at(STATS, INPUT), "bias": np.zeros(INPUT), "out": at(2 * HIDDEN), "skip": at(INPUT), "base": np.zeros(1)}
    for d in "fb":
        out[f"x{d}"], out[f"h{d}"], out[f"c{d}"] = at(INPUT, 4 * HIDDEN), at(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN)
        out[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # what is known is kept at first
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def embedded(model: dict, paths: list[np.ndarray], words: np.ndarray, stat: np.ndarray) -> np.ndarray:
    """(block, INPUT) before the bend: sums of embeddings of each block's path buckets, its words and statistics."""
    flat = np.concatenate(paths) if paths else np.zeros(0, np.int64)
    sizes = np.array([len(p) for p in paths])
    sums = np.add.reduceat(model["path"][flat], np.cumsum(sizes) - sizes, axis=0) if len(flat) else np.zeros((0, INPUT))
    return sums + words @ model["word"] + stat @ model["stat"] + model["bias"]


def _run(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray, keep: bool):
    """States (place, page, HIDDEN) of one direction; what the way back needs, if it is kept."""
    t, n, _ = x.shape
    h, c, states, trail = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.empty((t, n, HIDDEN)), []
    for i in range(t):
        z = x[i] @ wx + h @ wh + bias
        gates, new_c = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        enter, stay, leave = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        after = stay * c + enter * new_c
        bent = np.tanh(after)
        m = mask[i][:, None]
        if keep:
            trail.append((h, c, enter, stay, leave, new_c, bent, m))
        h, c = m * (leave * bent) + (1 - m) * h, m * after + (1 - m) * c
        states[i] = h
    return states, trail


def _back(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, trail: list, given: np.ndarray):
    """Gradients of one direction by what each state was blamed for."""
    gx, gwx, gwh, gb = np.empty_like(x), np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN)
    dh, dc = np.zeros_like(given[0]), np.zeros_like(given[0])
    for i in range(len(x) - 1, -1, -1):
        h, c, enter, stay, leave, new_c, bent, m = trail[i]
        dh = dh + given[i]
        own, over = m * dh, (1 - m) * dh
        d_after = m * dc + own * leave * (1 - bent * bent)
        dz = np.concatenate([d_after * new_c * enter * (1 - enter), d_after * c * stay * (1 - stay), own * bent * leave * (1 - leave), d_after * enter * (1 - new_c * new_c)], 1)
        gx[i] = dz @ wx.T
        gwx += x[i].T @ dz
        gwh += h.T @ dz
        gb += dz.sum(0)
        dh, dc = dz @ wh.T + over, d_after * stay + (1 - m) * dc
    return gx, gwx, gwh, gb


def _grid(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of pages one after the other as (place, page, ...) with a mask, and the place and page of each row."""
    page = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grid = np.zeros((int(sizes.max()), len(sizes), rows.shape[1]))
    grid[place, page] = rows
    mask = np.zeros(grid.shape[:2])
    mask[place, page] = 1
    return grid, mask, place, page


def logits(model: dict, z: np.ndarray, sizes: np.ndarray, keep: bool = False):
    """Of every row, given the embedded rows of pages one after the other: both directions read the whole page."""
    bent = np.tanh(z)
    grid, mask, place, page = _grid(bent, sizes)
    mirrored = np.repeat(sizes, sizes) - 1 - place
    turned = np.zeros_like(grid)
    turned[mirrored, page] = bent
    f, trail_f = _run(grid, mask, model["xf"], model["hf"], model["cf"], keep)
    b, trail_b = _run(turned, mask, model["xb"], model["hb"], model["cb"], keep)
    both = np.concatenate([f[place, page], b[mirrored, page]], 1)
    score = both @ model["out"] + bent @ model["skip"] + model["base"]
    return score, (bent, grid, turned, place, page, mirrored, both, trail_f, trail_b)


def gradients(model: dict, paths: list[np.ndarray], words: np.ndarray, stat: np.ndarray, sizes: np.ndarray, truth: np.ndarray) -> tuple[float, dict]:
    """Mean log loss over blocks and its gradients."""
    z = embedded(model, paths, words, stat)
    score, (bent, grid, turned, place, page, mirrored, both, trail_f, trail_b) = logits(model, z, sizes, True)
    p = _sigmoid(score)
    loss = float(-np.mean(truth * np.log(p + 1e-12) + (1 - truth) * np.log(1 - p + 1e-12)))
    d = (p - truth) / len(truth)
    out = {"out": both.T @ d, "skip": bent.T @ d, "base": np.array([d.sum()])}
    blame = d[:, None] * model["out"][None]
    d_bent = d[:, None] * model["skip"][None]
    for way, rows, at, trail, part in (("f", grid, place, trail_f, blame[:, :HIDDEN]), ("b", turned, mirrored, trail_b, blame[:, HIDDEN:])):
        given = np.zeros((*rows.shape[:2], HIDDEN))
        given[at, page] = part
        gx, out[f"x{way}"], out[f"h{way}"], out[f"c{way}"] = _back(rows, model[f"x{way}"], model[f"h{way}"], trail, given)
        d_bent = d_bent + gx[at, page]
    dz = d_bent * (1 - bent * bent)
    out |= {"word": words.T @ dz, "stat": stat.T @ dz, "bias": dz.sum(0), "path": np.zeros_like(model["path"])}
    np.add.at(out["path"], np.concatenate(paths), np.repeat(dz, [len(p) for p in paths], axis=0))
    return loss, out


def fit(pages: list[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]], rounds: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over batches of pages (paths, words, stats, truth) of like length, which come in another order each round."""
    model, r, step = new(seed), np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    order = sorted(range(len(pages)), key=lambda i: len(pages[i][3]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    for turn in range(rounds):
        for b in r.permutation(len(batches)):
            own = [pages[i] for i in batches[b]]
            paths = [p for page in own for p in page[0]]
            _, grads = gradients(model, paths, *[np.concatenate([page[k] for page in own]) for k in (1, 2)], np.array([len(page[3]) for page in own]), np.concatenate([page[3] for page in own]))
            step += 1
            for k, g in grads.items():
                g = np.clip(g, -1, 1) + 1e-4 * model[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = model[k] - rate * (1 - turn / (rounds + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model
