"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words.

A word enters as its own vector, if it is in the vocabulary, beside the mean vector of its character
trigrams; a word of more than PIECE_BYTES bytes enters as overlapping pieces, each like a word. Two
gated recurrent layers read a window forwards and backwards, attention pools their states, and a
logistic output scores the window. A window starts at every word that WINDOW words follow or begin; the
score of a text is that of its worst window. Windows of neighbouring words advance together, so each
step of a layer reads one slice of the text. Training is plain numpy on a bounded sample of labelled
texts: first on random windows, then on the windows that score highest, as a label belongs to a text
and not to a window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textfix.llm.quality import fit_ids, held_out

# Labelled texts that are fitted at most, per class; and words read of them in all.
FIT_TEXTS, FIT_WORDS = 1500, 3_000_000
WINDOW = 16
WORD_DIM, CHAR_DIM, HIDDEN, CHAR_ROWS = 8, 16, 8, 1 << 13
# Fitting: texts that must hold a word of the vocabulary, share of words read by their characters only,
# step size and the share by which weights shrink in a step.
LEAST_TEXTS, WORD_DROP, STEP, SHRINK = 5, 0.3, 0.01, 1e-4
# Bytes of a word that are one input; longer words are cut.
PIECE_BYTES = 16
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…*_#|-"
# Words whose inputs a Python worker remembers, windows scored together, words worked on together.
MEMO_WORDS, BLOCK, GROUP_WORDS = 200_000, 8192, 1 << 17


def split_word(word: str) -> list[str]:
    """Pieces of at most PIECE_BYTES bytes; neighbours share two bytes or more, so every trigram is in one."""
    pieces, begin, size = [], 0, 0
    for at, c in enumerate(word):
        wide = len(c.encode())
        if size + wide > PIECE_BYTES:
            pieces.append(word[begin:at])
            begin, size = at, 0
            while size < 2:
                begin -= 1
                size += len(word[begin].encode())
        size += wide
    return [*pieces, word[begin:]]


def words_of(text: str | None) -> list[str]:
    """The words of a text without marks at their edges; long ones in overlapping pieces."""
    out: list[str] = []
    for x in (text or "").lower().split():
        w = x.strip(EDGES)
        if len(w) * 4 <= PIECE_BYTES or len(w.encode()) <= PIECE_BYTES:
            if w:
                out.append(w)
        else:
            out += split_word(w)
    return out


def trigram_rows(words: list[str], width: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the trigrams of each word of up to ``width`` bytes and which count."""
    raw = [b"^" + w.encode() + b"$" for w in words]
    size = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
    start = np.r_[0, np.cumsum(size)[:-1]]
    many = np.maximum(size - 2, 1)
    spot = np.arange(width)[None] * np.maximum(many, width)[:, None] // width
    used = spot < many[:, None]
    at = start[:, None] + np.where(used, spot, 0)
    code = flat[at] * 65_599 + flat[at + 1] * 4_099 + flat[at + 2] * 257
    return (code ^ code >> 13) % CHAR_ROWS, used


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def bend(x: np.ndarray) -> np.ndarray:
    """The activation of the recurrent layers: from -1 to 1 like the hyperbolic tangent, at a seventh of its time."""
    return x / (1 + np.abs(x))


def slope(bent: np.ndarray) -> np.ndarray:
    """Derivative of :func:`bend` where its value is ``bent``."""
    return (1 - np.abs(bent)) ** 2


class Network:
    """Parameters by name. Word row 0 is every word outside the vocabulary and stays zero."""

    def __init__(self, vocabulary: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = {w: i for i, w in enumerate(vocabulary, 1)}
        h, wide = HIDDEN, WORD_DIM + CHAR_DIM

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.p = {
            "word": normal(len(vocabulary) + 1, WORD_DIM, scale=0.3),
            "char": normal(CHAR_ROWS, CHAR_DIM, scale=0.3),
            "attend": normal(2 * h, scale=0.3),
            "out": normal(2 * h, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0
        for d in ("f", "b"):
            self.p[f"{d}_in"] = normal(wide, 3 * h, scale=wide**-0.5)
            self.p[f"{d}_zr"] = normal(h, 2 * h, scale=h**-0.5)
            self.p[f"{d}_n"] = normal(h, h, scale=h**-0.5)
            self.p[f"{d}_bias"] = np.zeros(3 * h, np.float32)

    def inputs(self, words: list[str], unknown: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Input vectors of words, and what their gradient needs; ``unknown`` hides words."""
        own = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        if unknown is not None:
            own[unknown] = 0
        rows, used = trigram_rows(words)
        n = used.sum(axis=1, keepdims=True).astype(np.float32)
        chars = np.einsum("wkc,wk->wc", self.p["char"][rows], used.astype(np.float32)) / n
        return np.c_[self.p["word"][own], chars], (own, rows, used, n)

    def layer(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, window, h) of one direction; ``x`` has the projected inputs."""
        p, h = self.p, HIDDEN
        state = np.zeros((x.shape[1], h), np.float32)
        states, saved = np.empty((*x.shape[:2], h), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gates = 0.5 + 0.5 * bend(x[t, :, : 2 * h] + state @ p[f"{d}_zr"])
            z, r = gates[:, :h], gates[:, h:]
            inner = state @ p[f"{d}_n"]
            new = bend(x[t, :, 2 * h :] + r * inner)
            step = mask[t] * z
            saved.append((t, state, z, r, inner, new))
            state = state + step * (new - state)
            states[t] = state
        return states, saved

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention and pooled states."""
        told = states @ self.p["attend"] + (mask[..., 0] - 1) * 1e4
        told = np.exp(told - told.max(axis=0))
        share = told / told.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", share, states)
        return pooled @ self.p["out"] + self.p["bias"], share, pooled

    def gradients(
        self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray
    ) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the mean log loss, gradient of the input vectors, logits.

        ``table`` has the input vectors of words and ``ids`` (time, window) their rows.
        """
        p, h = self.p, HIDDEN
        x = table[ids]
        layers = {d: self.layer(d, x @ p[f"{d}_in"] + p[f"{d}_bias"], mask) for d in ("f", "b")}
        states = np.concatenate([layers["f"][0], layers["b"][0]], axis=2)
        logit, share, pooled = self.pool(states, mask)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        d_logit = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["bias"][0], g["out"] = d_logit.sum(), pooled.T @ d_logit
        d_pool = d_logit[:, None] * p["out"]
        d_share = np.einsum("tbh,bh->tb", states, d_pool)
        d_told = share * (d_share - (share * d_share).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", d_told, states)
        d_states = share[..., None] * d_pool + d_told[..., None] * p["attend"]
        d_x = np.zeros_like(x)
        for d, part in (("f", d_states[..., :h]), ("b", d_states[..., h:])):
            back, d_in = np.zeros((len(y), h), np.float32), np.zeros((*ids.shape, 3 * h), np.float32)
            for t, before, z, r, inner, new in reversed(layers[d][1]):
                back = back + part[t]
                step = mask[t] * z
                d_new = back * step * slope(new)
                d_z = back * mask[t] * (new - before) * slope(2 * z - 1) / 2
                d_r = d_new * inner * slope(2 * r - 1) / 2
                d_zr = np.c_[d_z, d_r]
                d_in[t] = np.c_[d_zr, d_new]
                g[f"{d}_zr"] += before.T @ d_zr
                g[f"{d}_n"] += before.T @ (d_new * r)
                back = back * (1 - step) + d_zr @ p[f"{d}_zr"].T + (d_new * r) @ p[f"{d}_n"].T
            flat = d_in.reshape(-1, 3 * h)
            g[f"{d}_in"] = x.reshape(-1, x.shape[2]).T @ flat
            g[f"{d}_bias"] = flat.sum(axis=0)
            d_x += d_in @ p[f"{d}_in"].T
        d_table = np.zeros_like(table)
        np.add.at(d_table, ids.reshape(-1), d_x.reshape(-1, x.shape[2]))
        return g, d_table, logit

    def scores(self, projected: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each window; ``projected`` has the gates' inputs by word row."""
        states = [self.layer(d, projected[d][ids], mask)[0] for d in ("f", "b")]
        return sigmoid(self.pool(np.concatenate(states, axis=2), mask)[0])

    def sweep(self, d: str, x: np.ndarray, many: int) -> np.ndarray:
        """Sums (time, 2, window) for attention and output, of one direction over windows of
        neighbouring words; ``x`` (3h, many + WINDOW - 1) has the gates' inputs of the words.

        The steps of :meth:`layer`, with windows side by side in memory. The product of a state with
        the recurrent weights gives its two sums too.
        """
        p, h = self.p, HIDDEN
        part = slice(0, h) if d == "f" else slice(h, 2 * h)
        turn = np.c_[p[f"{d}_zr"], p[f"{d}_n"] / 2, p["attend"][part], p["out"][part]].T.copy()
        state, told = np.zeros((h, many), np.float32), np.empty((WINDOW, 2, many), np.float32)
        moved, size = np.empty((3 * h + 2, many), np.float32), np.empty((2 * h, many), np.float32)
        gates, new, ends = moved[: 2 * h], moved[2 * h : 3 * h], moved[3 * h :]
        before = None
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            np.matmul(turn, state, out=moved)
            if before is not None:
                told[before] = ends
            gates += x[: 2 * h, t : t + many]
            np.abs(gates, out=size)
            size += 1
            gates /= size
            gates += 1  # twice the gates
            new *= gates[h:]
            new += x[2 * h :, t : t + many]
            np.abs(new, out=size[:h])
            size[:h] += 1
            new /= size[:h]
            new -= state
            new *= gates[:h]
            new *= 0.5
            state += new
            before = t
        np.matmul(turn[3 * h :], state, out=told[before])
        return told

    def neighbours(self, projected: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Chance of label 1 for the window that starts at each word; the last WINDOW - 1 start none."""
        many = len(ids) - WINDOW + 1
        told = sum(self.sweep(d, np.ascontiguousarray(projected[d][ids].T), many) for d in ("f", "b"))
        share = np.exp(told[:, 0] - told[:, 0].max(axis=0))
        return sigmoid((share * told[:, 1]).sum(axis=0) / share.sum(axis=0) + self.p["bias"])

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: (x @ self.p[f"{d}_in"] + self.p[f"{d}_bias"]).astype(np.float32) for d in ("f", "b")}


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows of texts that stand in one array: text, first word, end of the text.

    Each text has at least one, which is short if the text is.
    """
    many = np.maximum(sizes - WINDOW, 0) + 1
    text = np.repeat(np.arange(len(sizes)), many)
    begin = np.cumsum(sizes) - sizes
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, begin[text] + nth, (begin + sizes)[text]


def laid_out(ids: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word rows (time, window) and their mask."""
    spot = first[None] + np.arange(WINDOW)[:, None]
    mask = spot < end[None]
    rows = np.where(mask, ids[np.minimum(spot, max(len(ids) - 1, 0))] if len(ids) else 0, 0)
    return rows, mask[..., None].astype(np.float32)


def train(texts: list[list[str]], y: np.ndarray, rounds: tuple[int, int] = (3, 5), seed: int = 7) -> Network:
    """Fit on texts given as words. Frequent words are the vocabulary."""
    rng = np.random.default_rng(seed)
    seen = Counter(w for words in texts for w in set(words))
    net = Network(sorted(w for w, n in seen.items() if n >= LEAST_TEXTS), seed)
    if len(y) == 0 or y.min() == y.max():
        net.p["out"][:] = 0
        net.p["bias"][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return net
    names = sorted(seen)
    row = {w: i for i, w in enumerate(names)}
    ids = np.array([row[w] for words in texts for w in words], np.int64)
    sizes = np.array([len(words) for words in texts])
    text, first, end = windows(sizes)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for phase, many in enumerate(rounds):
        for _ in range(many):
            if phase == 0:
                drawn = rng.permutation(len(text))
                drawn = drawn[: 20 * len(texts)]
            else:
                drawn = rng.permutation(_top_windows(net, names, ids, sizes))
            for at in range(0, len(drawn), 128):
                step += 1
                batch = drawn[at : at + 128]
                rows, mask = laid_out(ids, first[batch], end[batch])
                used, local = np.unique(rows, return_inverse=True)
                x, (own, tri, on, n) = net.inputs([names[i] for i in used], rng.random(len(used)) < WORD_DROP)
                g, d_x, _ = net.gradients(x, local.reshape(rows.shape), mask, y[text[batch]])
                g["word"] = np.zeros_like(net.p["word"])
                np.add.at(g["word"], own, d_x[:, :WORD_DIM])
                g["word"][0] = 0
                g["char"] = np.zeros_like(net.p["char"])
                each = np.broadcast_to((d_x[:, WORD_DIM:] / n)[:, None], (*on.shape, CHAR_DIM))
                np.add.at(g["char"], tri[on], each[on])
                for k, (m, v) in moment.items():
                    m += 0.1 * (g[k] - m)
                    v += 0.001 * (g[k] ** 2 - v)
                    fair = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                    net.p[k] -= np.float32(STEP) * (fair + np.float32(SHRINK / STEP) * net.p[k])
    return net


def _top_windows(net: Network, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The window of each text that scores highest, and the highest of those half a window or more away."""
    text, first, _ = windows(sizes)
    score = _all_scores(net, net.project(net.inputs(names)[0]), ids, sizes)
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    best = np.lexsort((-score, text))[starts]
    away = np.flatnonzero(np.abs(first - first[best][text]) >= WINDOW // 2)
    order = away[np.lexsort((-score[away], text[away]))]
    return np.r_[best, order[np.r_[True, text[order][1:] != text[order][:-1]]]] if len(order) else best


def _all_scores(net: Network, projected: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores of all windows, in the order of :func:`windows`."""
    _, first, end = windows(sizes)
    out = np.empty(len(first), np.float32)
    short = end - first < WINDOW
    padded = np.flatnonzero(short)
    for at in range(0, len(padded), BLOCK):
        some = padded[at : at + BLOCK]
        out[some] = net.scores(projected, *laid_out(ids, first[some], end[some]))
    # The words of all other texts side by side; windows across two texts are left out at the end.
    full = sizes >= WINDOW
    if full.any():
        joined = ids[np.repeat(full, sizes)]
        every = np.empty(len(joined) - WINDOW + 1, np.float32)
        for at in range(0, len(every), BLOCK):
            every[at : at + BLOCK] = net.neighbours(projected, joined[at : at + BLOCK + WINDOW - 1])
        out[~short] = every[windows(sizes[full])[1]]
    return out


class Scorer:
    """Scores texts in a Python worker and remembers the inputs of the words seen last."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        room = MEMO_WORDS + GROUP_WORDS
        self.projected = {d: np.zeros((room, 3 * HIDDEN), np.float32) for d in ("f", "b")}

    def ids(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        new = list(dict.fromkeys([words[i] for i in np.flatnonzero(found < 0).tolist()]))
        if new:
            if len(self.row) + len(new) > len(self.projected["f"]):
                self.clear()
                new = list(dict.fromkeys(words))
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                base = len(self.row)
                for d, values in self.net.project(self.net.inputs(part)[0]).items():
                    self.projected[d][base : base + len(part)] = values
                self.row.update(zip(part, range(base, base + len(part)), strict=True))
            found = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        return found

    def scores(self, texts: list[str | None]) -> list[float]:
        """Of each text the score of its worst window; a text without words is one empty window."""
        out: list[float] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            words = words_of(text)
            if size + len(words) > GROUP_WORDS and group:
                out += self._group(group)
                group, size = [], 0
            if len(words) > GROUP_WORDS:
                out.append(self._long(words))
                continue
            group.append(words)
            size += len(words)
        return out + (self._group(group) if group else [])

    def _long(self, words: list[str]) -> float:
        """Pieces that overlap by a window, so that no window is missed."""
        step = GROUP_WORDS - WINDOW
        return max(
            self._group([words[at : at + step + WINDOW]])[0]
            for at in range(0, max(len(words) - WINDOW, 1), step)
        )

    def _group(self, group: list[list[str]]) -> list[float]:
        ids = self.ids([w for words in group for w in words])
        sizes = np.array([len(words) for words in group])
        found = _all_scores(self.net, self.projected, ids, sizes)
        many = np.maximum(sizes - WINDOW, 0) + 1
        starts = np.cumsum(many) - many
        return np.maximum.reduceat(found, starts).astype(float).tolist()


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
    text: str = "text", mod: int = 5, rest: int = 0, limit: int = FIT_TEXTS,
) -> Network:
    """Learn from at most ``limit`` labelled texts of each class and FIT_WORDS words of them.

    Beyond that the texts with the smallest hashed ids are taken, whole, until the words are spent.
    """
    parts = [
        fit_ids(labels.where(F.col(label) == y).select(id_col, label), label, id_col, mod, rest, limit)
        for y in (1, 0)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    size = F.length(F.col(text))
    rows = docs.select(id_col, text).join(chosen, id_col).select(id_col, text, "y", size.alias("n"))
    # Long texts are left out of the fit: at most FIT_WORDS / (2 limit) words of 7 characters each.
    rows = rows.where(F.col("n") <= 7 * FIT_WORDS // (2 * limit)).dropDuplicates([id_col])
    found = rows.orderBy(id_col).select(text, "y").collect()
    return train([words_of(r[0]) for r in found], np.array([r[1] for r in found], np.float32))


def score(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
    text: str = "text", mod: int = 5, rest: int = 0,
) -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``; a NULL text counts as empty.

    Every window of every whole text is scored. Learning reads only rows whose crc32 of the id is not
    ``rest`` modulo ``mod``; only the text is an input. With one class or no labels the score is a
    constant.
    """
    net = fit(docs, labels, label, id_col, text, mod, rest)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scorer.scores(texts), pa.float64())], [id_col, "score"]
            )

    out = docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return out.select(
        id_col,
        held_out(F.col(id_col), mod, rest).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
