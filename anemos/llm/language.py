"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anemos.llm._common import text_slices

#: Texts are read in windows of so many bytes; the state starts anew in each. LANES windows run side by side.
WINDOW, LANES = 128, 2048


@dataclass
class ByteGRU:
    """Weights of both directions d = 0, 1: `table` (3H x 256: what a byte adds to the gates), `turn` (3H x H), and the output
    layer (languages x 2H). Gates are update, reset, candidate."""

    languages: list[str]
    table: list[np.ndarray] = field(default_factory=list)
    turn: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    bias: np.ndarray | None = None

    @staticmethod
    def start(languages: list[str], size: int, rng: np.random.Generator) -> ByteGRU:
        draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        return ByteGRU(languages, [0.3 * draw(3 * size, 256) for _ in range(2)], [0.3 * draw(3 * size, size) for _ in range(2)], 0.3 * draw(len(languages), 2 * size), np.zeros((len(languages), 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.table, *self.turn, self.out, self.bias]

    def step(self, d: int, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step of direction d for many windows: the new state, and what backpropagation needs."""
        n = len(h)
        a = self.table[d].take(byte, axis=1)
        g = self.turn[d] @ h
        zr = a[: 2 * n]
        zr += g[: 2 * n]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:n], zr[n:]
        c = r * g[2 * n :]
        c += a[2 * n :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, z, r, c, g[2 * n :]

    def states(self, d: int, x: np.ndarray, keep: bool = False, inside: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States (T x H x N) of direction d over windows x (T x N). Where `inside` is false the state stays zero, so that the
        bytes which pad a short window count for nothing."""
        steps, lanes = x.shape
        size = self.turn[d].shape[1]
        h = np.zeros((size, lanes), np.float32)
        out, kept = np.empty((steps, size, lanes), np.float32), []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            before = h
            h, *inner = self.step(d, x[t], h)
            if inside is not None:
                h *= inside[t]
            out[t] = h
            if keep:
                kept.append((t, before, *inner))
        return out, kept

    def positions(self, x: np.ndarray, inside: np.ndarray) -> Iterator[np.ndarray]:
        """Language probabilities (languages x N) of each position of windows x (T x N) of which `inside` is text."""
        ahead = self.states(0, x, inside=inside)[0]
        behind = self.states(1, x, inside=inside)[0]
        size = ahead.shape[1]
        for t in range(len(x)):
            yield _softmax(self.out[:, :size] @ ahead[t] + self.out[:, size:] @ behind[t] + self.bias)

    def gradient(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of all positions of windows x, each labelled with its text's language, and its gradient by
        backpropagation through time."""
        steps, lanes = x.shape
        both = [self.states(d, x, keep=True) for d in (0, 1)]
        size = both[0][0].shape[1]
        feats = np.concatenate([both[0][0], both[1][0]], 1).transpose(1, 0, 2).reshape(2 * size, -1)
        p = _softmax(self.out @ feats + self.bias)
        y = np.tile(label, steps)
        at = np.arange(steps * lanes)
        loss = float(-np.log(np.maximum(p[y, at], 1e-9)).mean())
        p[y, at] -= 1
        p /= steps * lanes
        d_out, d_bias = p @ feats.T, p.sum(1, keepdims=True)
        d_feats = (self.out.T @ p).reshape(2 * size, steps, lanes)
        d_table, d_turn = [], []
        for d in (0, 1):
            part = d_feats[d * size : (d + 1) * size]
            dh = np.zeros((size, lanes), np.float32)
            turned = np.zeros_like(self.turn[d])
            inputs = np.empty((steps, 3 * size, lanes), np.float32)
            for t, before, z, r, c, g in reversed(both[d][1]):
                dh = dh + part[:, t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (before - c) * z * (1 - z)
                dr = dc * g * r * (1 - r)
                inputs[t] = np.concatenate([dz, dr, dc])
                inner = np.concatenate([dz, dr, dc * r])
                turned += inner @ before.T
                dh = dh * z + self.turn[d].T @ inner
            flat, rows = x.ravel(), inputs.transpose(1, 0, 2).reshape(3 * size, -1)
            d_table.append(np.stack([np.bincount(flat, weights=row, minlength=256) for row in rows]).astype(np.float32))
            d_turn.append(turned)
        return loss, [*d_table, *d_turn, d_out, d_bias]

    def classify(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts x languages): mean of the position probabilities of each whole text; zeros for an empty text."""
        n = np.diff(offs)
        windows = -(-n // WINDOW)
        doc = np.repeat(np.arange(len(n)), windows)
        first = offs[:-1][doc] + WINDOW * (np.arange(len(doc)) - (np.cumsum(windows) - windows)[doc])
        size = np.minimum(WINDOW, offs[1:][doc] - first)
        total = np.zeros((len(n), len(self.languages)))
        order = np.argsort(-size, kind="stable")
        for lo in range(0, len(order), LANES):
            part = order[lo : lo + LANES]
            steps = np.arange(int(size[part[0]]))[:, None]
            inside = steps < size[part]
            x = np.where(inside, buf[np.minimum(first[part] + steps, len(buf) - 1)], np.uint8(32))
            pooled = np.zeros((len(self.languages), len(part)), np.float32)
            for t, p in enumerate(self.positions(x, inside)):
                pooled += p * inside[t]
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(doc[part], weights=pooled[k], minlength=len(n))
        return total / np.maximum(n, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def train(languages: list[str], windows: np.ndarray, label: np.ndarray, size: int = 8, steps: int = 240, batch: int = 256, rate: float = 0.02, seed: int = 7) -> ByteGRU:
    """Fit on windows (N x T bytes) with Adam; languages weigh alike, whatever their share of the windows."""
    rng = np.random.default_rng(seed)
    net = ByteGRU.start(languages, size, rng)
    by_language = [np.flatnonzero(label == k) for k in range(len(languages))]
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, -(-batch // len(languages))) for rows in by_language])
        _, grads = net.gradient(windows[pick].T, label[pick])
        pace = rate * min(1, 3 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def fit_language(docs: DataFrame, most: int = 1500, per_text: int = 8, length: int = 48, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> ByteGRU:
    """Train on windows of at most `most` documents with a known language, those whose ids hash lowest: the documented bound
    of what reaches the driver is most x per_text windows of `length` bytes. Windows are spread over the whole text."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    picked = known.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(most)
    rows = known.join(F.broadcast(picked.select("id").distinct()), "id").select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, window = [], []
            for lo, hi, buf, offs in text_slices(batch.column(1)):
                for i in range(hi - lo):
                    n = int(offs[i + 1] - offs[i])
                    for start in sorted({int(s) for s in np.linspace(0, max(0, n - length), per_text)}) if n else []:
                        piece = buf[offs[i] + start : min(offs[i] + start + length, offs[i + 1])].tobytes()
                        lang.append(batch.column(0)[lo + i].as_py())
                        window.append(piece.ljust(length))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(window, pa.binary())], names=["lang", "window"])

    got = rows.mapInArrow(cut, "lang string, window binary").toArrow().to_pydict()
    pairs = sorted(zip(got["lang"], got["window"]))
    languages = sorted({p[0] for p in pairs})
    if not languages:
        return ByteGRU([])
    x = np.frombuffer(b"".join(bytes(p[1]) for p in pairs), np.uint8).reshape(-1, length)
    return train(languages, x, np.array([languages.index(p[0]) for p in pairs]), **options)


def detect_language(docs: DataFrame, net: ByteGRU, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs' columns plus the predicted language of the whole text and its pooled probability. A text that is null or has no
    letter is `und` with score 0, and so is every text if nothing was learned. Columns of these names are replaced."""
    docs = docs.drop(pred_col, score_col)
    held = docs.sparkSession.sparkContext.broadcast(net)
    where = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for _, _, buf, offs in text_slices(batch.column(where)):
                if not held.value.languages:
                    names += ["und"] * (len(offs) - 1)
                    scores.append(np.zeros(len(offs) - 1))
                    continue
                p = held.value.classify(buf, offs)
                names += [held.value.languages[k] for k in p.argmax(1)]
                scores.append(p.max(1).clip(0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=schema.names)

    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = docs.mapInArrow(per_batch, schema)
    return out.withColumns({pred_col: F.when(lettered, F.col(pred_col)).otherwise("und"), score_col: F.when(lettered, F.col(score_col)).otherwise(0.0)})
