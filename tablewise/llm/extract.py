"""Main text of web pages by a recurrent labeller of their blocks.

A page is the sequence of its leaf blocks. Each is a vector of its tag path, of its hashed words and of a few
measures; a bidirectional LSTM in numpy reads the sequence both ways, so that every block is labelled in the
light of the whole page. It learns from pages of the table, labelled by their own semantic elements, and
from pages that dress their texts in many other layouts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import ref
from tablewise.llm.batches import LOWER, buffer_of, coded, pieces, slices, spread_indices
from tablewise.llm.html_blocks import Block, leaf_blocks
from tablewise.llm.layouts import MAIN, OTHER, PARTS, Dresser
from tablewise.llm.ngrams import NO_LETTER
from tablewise.plans.shape import spread

PATH_BUCKETS, WORD_BUCKETS = 2048, 2048
PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 16, 8, 6, 16
#: Pages that are learned from at most (about), and the most characters of one of them.
SAMPLE_PAGES, SAMPLE_CHARS = 300, 100_000
LAYOUTS, STEPS, BATCH = 1500, 420, 32
#: Blocks times pages that are labelled at once.
CELLS = 1 << 16

#: Elements whose text the teacher takes for furniture even inside an article.
FURNITURE = {"nav", "header", "footer", "aside", "form", "head", "noscript", "template"}
FURNITURE_NAMES = {"." + part for names in PARTS.values() for n in names for part in n.split("-")} - {".page", ".box", ".more", ".site"}


def _buckets(block: Block) -> list[int]:
    return [zlib.crc32(w.encode()) % PATH_BUCKETS for w in block.path] + [zlib.crc32(("own " + w).encode()) % PATH_BUCKETS for w in block.own]


@dataclass
class Sequence:
    """Blocks of pages, flat: where each page's blocks begin, and where each block's path and words begin."""

    pages: np.ndarray
    path: np.ndarray
    path_at: np.ndarray
    words: np.ndarray
    words_at: np.ndarray
    measures: np.ndarray

    def take(self, rows: np.ndarray) -> Sequence:
        """The same for some of the pages."""
        size = self.pages[rows + 1] - self.pages[rows]
        blocks = spread_indices(self.pages[rows], size)
        flat = []
        for keys, at in ((self.path, self.path_at), (self.words, self.words_at)):
            n = at[blocks + 1] - at[blocks]
            flat += [keys[spread_indices(at[blocks], n)], np.concatenate([[0], np.cumsum(n)])]
        return Sequence(np.concatenate([[0], np.cumsum(size)]), *flat, self.measures[blocks])


def _sequence(pages: list[list[Block]]) -> Sequence:
    blocks = [b for page in pages for b in page]
    at = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    known: dict[tuple, list[int]] = {}
    paths = []
    for b in blocks:
        key = (tuple(b.path), tuple(b.own))
        if key not in known:
            known[key] = _buckets(b)
        paths.append(known[key])
    raw, offsets = buffer_of(pa.array([b.text for b in blocks], pa.large_string()))
    words, words_at = pieces(LOWER[raw], offsets, NO_LETTER)
    index, distinct = coded(words)
    hashed = np.array([zlib.crc32(w.as_buffer()) % WORD_BUCKETS for w in distinct], np.int64)
    size, n_words = np.diff(offsets).astype(float), np.diff(words_at)
    linked = np.array([b.linked / max(1, len(b.text)) for b in blocks], float)
    stops = np.concatenate([[0], np.cumsum(np.isin(raw, [0x21, 0x2E, 0x3F]))])
    count = np.repeat(np.diff(at), np.diff(at))
    place = np.arange(len(blocks)) - np.repeat(at[:-1], np.diff(at))
    measures = np.stack(
        [np.log1p(n_words) / 4, linked, np.minimum(1, (stops[offsets[1:]] - stops[offsets[:-1]]) / np.maximum(1, n_words) * 8),
         np.log1p(size) / 6, (place + 0.5) / np.maximum(1, count), np.log1p(count) / 5], 1)
    return Sequence(
        at, np.array([x for p in paths for x in p], np.int64), np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64),
        hashed[index] if len(index) else index, words_at, measures.reshape(len(blocks), MEASURES),
    )


def _sums(table: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the table's rows of each block's keys."""
    out = np.zeros((len(at) - 1, table.shape[1]))
    full = np.flatnonzero(at[:-1] < at[1:])
    if len(full):
        out[full] = np.add.reduceat(table[keys], at[:-1][full], axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    """States of one direction over ``x`` (time, row, feature); with ``keep`` what the way back needs."""
    steps, rows, _ = x.shape
    h, c, n = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN)), HIDDEN
    z, out, kept = x @ wx + b, np.empty((steps, rows, HIDDEN)), []
    for t in range(steps):
        a = z[t] + h @ wh
        gate, new = _sigmoid(a[:, : 3 * n]), np.tanh(a[:, 3 * n :])
        before, c = c, gate[:, n : 2 * n] * c + gate[:, :n] * new
        bent = np.tanh(c)
        if keep:
            kept.append((h, before, gate, new, bent))
        h = gate[:, 2 * n :] * bent
        out[t] = h
    return out, kept


def lstm_back(x, wx, wh, kept, above):
    """Gradients of ``lstm`` for its input and weights, given those of its states."""
    n, dwh = HIDDEN, np.zeros_like(wh)
    dz, dh, dc = np.empty((*x.shape[:2], 4 * n)), 0.0, 0.0
    for t in range(len(kept) - 1, -1, -1):
        h, before, gate, new, bent = kept[t]
        i, f, o = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :]
        dh = dh + above[t]
        dc = dc + dh * o * (1 - bent * bent)
        d = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - new * new)], 1)
        dz[t], dc = d, dc * f
        dwh += h.T @ d
        dh = d @ wh.T
    flat = dz.reshape(-1, 4 * n)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


@dataclass
class BlockLabeller:
    weights: dict[str, np.ndarray]

    @staticmethod
    def start(seed: int = 0) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        w = {"path": rng.normal(0, 0.1, (PATH_BUCKETS, PATH_SIZE)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_SIZE))}
        for side in ("f", "b"):
            w["x" + side] = rng.normal(0, size**-0.5, (size, 4 * HIDDEN))
            w["h" + side] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            w["c" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        w["out"], w["bias"] = rng.normal(0, 0.1, 2 * HIDDEN + size), np.zeros(1)
        return BlockLabeller(w)

    def vectors(self, s: Sequence) -> np.ndarray:
        w = self.weights
        words = _sums(w["word"], s.words, s.words_at) / np.maximum(1, np.diff(s.words_at))[:, None]
        return np.concatenate([np.tanh(_sums(w["path"], s.path, s.path_at)), words, s.measures], 1)

    def probabilities(self, s: Sequence) -> np.ndarray:
        """For every block that it is content. Pages of like length are read side by side."""
        w, x = self.weights, self.vectors(s)
        out, sizes = np.zeros(len(x)), np.diff(s.pages)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        last = len(order)
        while last:
            longest = int(sizes[order[last - 1]])
            first = max(0, last - max(1, CELLS // longest))
            rows = order[first:last]
            there, back = _places(s.pages, rows)
            both = [lstm(x[p], w["x" + d], w["h" + d], w["c" + d])[0] for d, p in (("f", there), ("b", back))]
            inside = np.arange(longest)[:, None] < sizes[rows]
            score = np.empty(inside.shape)
            score[:] = both[0] @ w["out"][:HIDDEN]
            reverse = both[1] @ w["out"][HIDDEN : 2 * HIDDEN]
            out[there[inside]] += score[inside]
            out[back[inside]] += reverse[inside]
            last = first
        return _sigmoid(out + x @ w["out"][2 * HIDDEN :] + w["bias"])


def _places(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of each step of each page (time, page), forward and backward; past the end the first one."""
    size = at[rows + 1] - at[rows]
    step = np.arange(int(size.max()))[:, None]
    inside = step < size
    return np.where(inside, at[rows] + step, at[rows]), np.where(inside, at[rows + 1] - 1 - step, at[rows])


def _key_sums(size: int, keys: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each key the sum of its blocks' rows: how ``_sums`` passes gradients back."""
    return np.stack([np.bincount(keys, rows[owner, k], size) for k in range(rows.shape[1])], 1)


def loss_and_gradients(model: BlockLabeller, s: Sequence, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the blocks of some pages and its gradients."""
    w, rows = model.weights, np.flatnonzero(np.diff(s.pages))
    x = model.vectors(s)
    bent = x[:, :PATH_SIZE]
    there, back = _places(s.pages, rows)
    inside = np.arange(len(there))[:, None] < np.diff(s.pages)[rows]
    score, runs = x @ w["out"][2 * HIDDEN :] + w["bias"], {}
    for k, (side, place) in enumerate((("f", there), ("b", back))):
        states, kept = lstm(x[place], w["x" + side], w["h" + side], w["c" + side], keep=True)
        runs[side] = (place, states, kept, slice(k * HIDDEN, (k + 1) * HIDDEN))
        score[place[inside]] += (states @ w["out"][runs[side][3]])[inside]
    p = _sigmoid(score)
    loss = -np.mean(np.where(labels > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12)))
    d = (p - labels) / len(labels)
    grads = {"bias": np.array([d.sum()]), "out": np.empty_like(w["out"])}
    grads["out"][2 * HIDDEN :] = x.T @ d
    dx = d[:, None] * w["out"][None, 2 * HIDDEN :]
    for side, (place, states, kept, part) in runs.items():
        ds = np.where(inside, d[place], 0.0)
        grads["out"][part] = np.einsum("tbh,tb->h", states, ds)
        below, *own = lstm_back(x[place], w["x" + side], w["h" + side], kept, ds[:, :, None] * w["out"][part])
        grads["x" + side], grads["h" + side], grads["c" + side] = own
        dx[place[inside]] += below[inside]
    sizes, n_words = np.diff(s.path_at), np.diff(s.words_at)
    grads["path"] = _key_sums(PATH_BUCKETS, s.path, np.repeat(np.arange(len(x)), sizes), dx[:, :PATH_SIZE] * (1 - bent * bent))
    of_word = dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / np.maximum(1, n_words)[:, None]
    grads["word"] = _key_sums(WORD_BUCKETS, s.words, np.repeat(np.arange(len(x)), n_words), of_word)
    return float(loss), grads


def train(pages: list[list[Block]], labels: list[np.ndarray], steps: int = STEPS, rate: float = 0.01, seed: int = 0) -> BlockLabeller:
    """Adam over batches of pages, the rate falling to nothing."""
    model, rng = BlockLabeller.start(seed), np.random.default_rng(seed)
    everything, y = _sequence(pages), np.concatenate(labels)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    for step in range(1, steps + 1):
        chosen = rng.integers(len(pages), size=BATCH)
        blocks = spread_indices(everything.pages[chosen], everything.pages[chosen + 1] - everything.pages[chosen])
        _, grads = loss_and_gradients(model, everything.take(chosen), y[blocks])
        for k, g in grads.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model.weights[k] -= rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def teacher(block: Block) -> float:
    """Label of a block by the semantic elements above it."""
    inside = "article" in block.path or "main" in block.path
    return float(inside and not any(w in FURNITURE or w in FURNITURE_NAMES for w in block.path))


def fit_labeller(
    pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS, layouts: int = LAYOUTS, steps: int = STEPS,
    html_col="html", seed: int = 0,
) -> BlockLabeller:
    """Learn from about ``sample_pages`` pages of at most ``sample_chars`` characters, by hash of the page, and
    from ``layouts`` pages dressed from their texts."""
    page = ref(html_col).cast("string")
    able = pages.select(page.alias("html")).where(F.length("html").between(1, sample_chars))
    able = able.withColumn("h", F.xxhash64("html"))
    n = able.count()
    drawn = able.where(F.pmod("h", F.lit(1 << 20)) < sample_pages / max(1, n) * (1 << 20)).orderBy("h").limit(2 * sample_pages)
    parsed = [leaf_blocks(r["html"]) for r in drawn.collect()]  # at most 2 * sample_pages * sample_chars characters
    labels = [np.array([teacher(b) for b in blocks]) for blocks in parsed]
    prose = [b.text for blocks, y in zip(parsed, labels) for b, v in zip(blocks, y) if v]
    small = [b.text for blocks, y in zip(parsed, labels) for b, v in zip(blocks, y) if not v and "title" not in b.own]
    # pages that name no content teach nothing
    both = [(b, y) for b, y in zip(parsed, labels) if y.any()]
    dresser = Dresser(prose, small, seed)
    for _ in range(layouts):
        blocks = leaf_blocks(dresser.page())
        y = np.array([float(b.text.startswith(MAIN)) for b in blocks])
        for b in blocks:
            b.text = b.text.replace(MAIN, "").replace(OTHER, "")
        both.append((blocks, y))
    order = np.random.default_rng(seed).permutation(len(both))
    return train([both[i][0] for i in order], [both[i][1] for i in order], steps, seed=seed)


def extract_text(pages: DataFrame, model: BlockLabeller, id_col="page_id", html_col="html", keep=("url",)) -> DataFrame:
    """``page_id, ..., text, n_chars`` of every row: its content blocks in page order, one a line.

    White space inside a block (also no-break spaces) is one space. A null, empty or textless page, and one without content,
    has an empty text. Repeated rows and null keys are rows like others.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("page_id", T.LongType())] + [T.StructField(c, pages.schema[c].dataType) for c in keep]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        for rows, _, _ in slices(batches, "_html"):
            found = [leaf_blocks(p) for p in rows.column("_html").to_pylist()]
            sequence = _sequence(found)
            chosen = shared.value.probabilities(sequence) >= 0.5
            texts = [
                "\n".join(b.text for b, c in zip(blocks, chosen[first : first + len(blocks)]) if c)
                for blocks, first in zip(found, sequence.pages)
            ]
            own = [rows.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    page = F.coalesce(ref(html_col).cast("string"), F.lit("")).alias("_html")
    plain = pages.select(ref(id_col).cast("long").alias("page_id"), *[ref(c) for c in keep], page)
    return spread(plain).mapInArrow(run, schema)
