"""Document quality from a linear-chain conditional random field over lines (operator 2).

Every line with a word is a node with the states bad (0) and good (1).  A node's score looks at
the features of the line and of the lines before and after it, and neighbouring states have
scores of their own.  Forward-backward gives each line's probability of being good; their mean,
weighted by the lines' lengths, is put on the scale of the labels by a logistic curve.  Lines
take the label of their document in training.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrascope.llm.shared import map_arrow
from lyrascope.llm.text import SPACE, binary, encode, flat, map_chunks, runs, sums
from lyrascope.llm.weak_rules import repeated_windows

FOLDS = 5
THRESHOLD = 0.3

# Labelled documents that the field is fitted on at most, in the order of a hash of doc_id.
TRAINING_DOCUMENTS = 3000

STEPS = 120
RATE = 0.1
DECAY = 1e-3


def _bytes(members) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(members)] = 1
    return table


# Kinds of bytes whose share of a line is a feature.
KINDS = [
    _bytes(b"#*$%&|<>"),
    _bytes(b".,;:?'\"()-"),
    _bytes(b"!"),
    _bytes(b"|"),
    _bytes(range(65, 91)),
    _bytes(range(97, 123)),
    _bytes(b"0123456789"),
    _bytes(b"@/\\_=+{}[]~^`"),
    _bytes(range(128, 256)),
    _bytes([0x20, 0x09, 0x0B, 0x0C, 0x0D]),
]
ENDS = _bytes(b".!?:;\"'")
N_FEATURES = len(KINDS) + 9


@dataclass
class Lines:
    """Lines with a word: ``offsets`` has the texts' places among them."""

    offsets: np.ndarray
    weights: np.ndarray  # bytes
    features: np.ndarray  # line, feature


def lines(texts: pa.Array) -> Lines:
    offsets, data = flat(texts)
    within = data != 0x0A
    starts, ends = runs(offsets, data, within)
    if not len(starts):
        return Lines(np.zeros_like(offsets), np.empty(0), np.empty((0, N_FEATURES)))
    solid = ~SPACE[data]
    first, last = runs(offsets, data, solid)
    found = encode(offsets, first, last - first, data[solid])
    line = np.searchsorted(starts, first, "right") - 1
    n = len(starts)
    size = (ends - starts).astype(float)
    count = np.bincount(line, minlength=n)
    counted = np.maximum(count, 1)
    copies = binary(ends - starts, data[within]).dictionary_encode().indices.to_numpy()
    owner = np.searchsorted(offsets, starts, "right") - 1
    _, again, times = np.unique(
        owner * (int(copies.max()) + 1) + copies, return_inverse=True, return_counts=True
    )
    pairs = np.unique(line * max(len(found.distinct), 1) + found.codes)
    repeats = np.bincount(line, weights=repeated_windows(found), minlength=n)
    ended = ENDS[data[last - 1]] if len(last) else np.empty(0)
    features = [np.add.reduceat(kind[data], starts, dtype=np.int64) / size for kind in KINDS]
    features += [
        np.log1p(size) / 5,
        np.log1p(count) / 3,
        np.log1p(size / counted),
        features[2] * size / counted,
        ENDS[data[ends - 1]].astype(float),
        np.log1p(times[again] - 1.0),
        repeats / counted,
        np.bincount(pairs // max(len(found.distinct), 1), minlength=n) / np.minimum(counted, 100),
        np.bincount(line, weights=ended, minlength=n) / counted,
    ]
    use = count > 0
    places = np.r_[0, np.cumsum(use)][np.searchsorted(starts, offsets)]
    return Lines(places, size[use], np.stack(features, 1)[use])


def inputs(found: Lines) -> np.ndarray:
    """Features of each line, of the lines before and after it, and a one."""
    x, n = found.features, len(found.features)
    beside = np.zeros((n, 2 * x.shape[1] + 2))
    inner = np.ones(n + 1, bool)
    inner[found.offsets] = False
    rows = np.flatnonzero(inner[:n])
    beside[rows, : x.shape[1]] = x[rows - 1]
    beside[rows - 1, x.shape[1] : -2] = x[rows]
    beside[rows, -2] = 1
    beside[rows - 1, -1] = 1
    return np.hstack([x, beside, np.ones((n, 1))])


def forward_backward(score: np.ndarray, step: np.ndarray, offsets: np.ndarray):
    """Probability of good of each line, and the expected transitions by state and state.

    ``score`` is a line's score of good over bad, ``step`` the scores of state pairs.  Texts
    go through their lines side by side, the longest first.
    """
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    begin, n = offsets[:-1][order], n[order]
    node = np.ones((len(score), 2))
    node[:, 1] = np.exp(np.clip(score, -30, 30))
    node /= node.sum(1, keepdims=True)
    move = np.exp(step - step.max())
    ahead, back = node.copy(), np.ones_like(node)
    most = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(1, most + 1), "right")
    for t in range(1, most):
        at = begin[: alive[t]] + t
        value = (ahead[at - 1] @ move) * node[at]
        ahead[at] = value / value.sum(1, keepdims=True)
    for t in range(most - 1, 0, -1):
        at = begin[: alive[t]] + t
        value = (back[at] * node[at]) @ move.T
        back[at - 1] = value / value.sum(1, keepdims=True)
    both = ahead * back
    both /= both.sum(1, keepdims=True)
    inner = np.ones(len(score) + 1, bool)
    inner[offsets] = False
    at = np.flatnonzero(inner[: len(score)])
    pair = ahead[at - 1][:, :, None] * move * (back[at] * node[at])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return both[:, 1], pair


@dataclass
class QualityField:
    """Weights of line features and state pairs, and the curve from lines to documents."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    curve: tuple[float, float]

    def line_probabilities(self, found: Lines) -> np.ndarray:
        x = (inputs(found) - self.mean) / self.scale
        return forward_backward(x @ self.weights, self.step, found.offsets)[0]

    def document_scores(self, found: Lines) -> np.ndarray:
        """Probability of good by document; a document without a line counts as all bad."""
        logit = _logit(_weighted(self.line_probabilities(found), found))
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * logit + b, -500, 500)))


def _weighted(good: np.ndarray, found: Lines) -> np.ndarray:
    total = sums(found.weights, found.offsets)
    part = sums(good * found.weights, found.offsets)
    return np.divide(part, total, out=np.zeros(len(total)), where=total > 0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Maximise by Adam from the gradient."""
    value, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(value)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        value += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return value


def fit_field(found: Lines, labels: np.ndarray) -> QualityField:
    """Fit the field by gradient on the conditional likelihood of the lines' labels.

    Lines weigh by their documents, so that a document of many lines counts like any other.
    Without both labels all documents score the (smoothed) share of good ones.
    """
    x = inputs(found)
    mean, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not len(x) or labels.min() == labels.max():
        curve = (0.0, float(np.log(share / (1 - share))))
        return QualityField(mean, scale, np.zeros(x.shape[1]), np.zeros((2, 2)), curve)
    mean[:-1], scale[:-1] = x[:, :-1].mean(0), x[:, :-1].std(0) + 1e-6
    x = (x - mean) / scale
    n = np.diff(found.offsets)
    # Both labels weigh the same in all; the curve below puts the shares right.
    even = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / np.maximum(n, 1)
    weight = np.repeat(even, n) / len(labels)
    truth = np.repeat(labels, n).astype(float)
    inner = np.ones(len(x) + 1, bool)
    inner[found.offsets] = False
    at = np.flatnonzero(inner[: len(x)])
    same = np.zeros((len(at), 2, 2))
    state = truth[at].astype(int)
    same[np.arange(len(at)), state, state] = 1

    def gradient(value):
        weights, step = value[:-4], value[-4:].reshape(2, 2)
        good, pair = forward_backward(x @ weights, step, found.offsets)
        moved = ((same - pair) * weight[at][:, None, None]).sum(0)
        return np.r_[x.T @ (weight * (truth - good)), moved.ravel()] - DECAY * value

    value = _adam(gradient, np.zeros(x.shape[1] + 4), STEPS, RATE)
    field = QualityField(mean, scale, value[:-4], value[-4:].reshape(2, 2), (1.0, 0.0))
    logit = _logit(_weighted(field.line_probabilities(found), found))

    def curve(value):
        p = 1 / (1 + np.exp(-np.clip(value[0] * logit + value[1], -500, 500)))
        return np.array([((labels - p) * logit).mean(), (labels - p).mean()]) - DECAY * value

    a, b = _adam(curve, np.array([1.0, 0.0]), 400, 0.05)
    field.curve = (float(max(a, 0.0)), float(b))
    return field


def _fold() -> F.Column:
    # A NULL doc_id belongs to no learnable document.
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, documents: int = TRAINING_DOCUMENTS) -> QualityField:
    """Fit on labelled documents outside the held-out fold, at most ``documents`` of them.

    ``labels`` has doc_id and quality (0 or 1, others are ignored).  The ids are chosen from
    the labels alone, so at most that many rows are broadcast and texts are not shuffled.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long"), "quality")
        .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (_fold() != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(documents)
    )
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    labelled = texts.join(F.broadcast(chosen), "doc_id").select("text", "quality", "doc_id")

    def describe(chunk: pa.RecordBatch) -> pa.RecordBatch:
        found = lines(chunk.column("text"))
        kept = found.features.astype(np.float32)
        cut = range(len(found.offsets) - 1)
        places = found.offsets
        return pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                chunk.column("quality").cast(pa.int32()),
                pa.array([kept[places[i] : places[i + 1]].tobytes() for i in cut], pa.binary()),
                pa.array(
                    [found.weights[places[i] : places[i + 1]].tobytes() for i in cut], pa.binary()
                ),
            ],
            ["doc_id", "quality", "features", "weights"],
        )

    rows = map_arrow(
        labelled, map_chunks(describe), "doc_id long, quality int, features binary, weights binary"
    ).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["features"]))
    features = [np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    found = Lines(
        np.r_[0, np.cumsum([len(f) for f in features], dtype=np.int64)],
        np.concatenate([np.frombuffer(r["weights"], float) for r in rows] or [np.empty(0)]),
        np.concatenate([*features, np.empty((0, N_FEATURES), np.float32)]).astype(float),
    )
    return fit_field(found, np.array([r["quality"] for r in rows], int))


def score(docs: DataFrame, field: QualityField) -> DataFrame:
    """doc_id, score and predicted of documents (doc_id, text), in one narrow map.

    NULL, empty and blank texts have no line and score as wholly bad; rows of one doc_id are
    scored each; further columns are left out.
    """

    def score_chunk(chunk: pa.RecordBatch) -> pa.RecordBatch:
        scores = field.document_scores(lines(chunk.column("text")))
        return pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                pa.array(scores),
                pa.array((scores >= THRESHOLD).astype(np.int32)),
            ],
            ["doc_id", "score", "predicted"],
        )

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return map_arrow(texts, map_chunks(score_chunk), "doc_id long, score double, predicted int")


def with_fold(scored: DataFrame) -> DataFrame:
    """Add held_out: whether the document is in the fold that no label was learnt from."""
    return scored.select("doc_id", (_fold() == 0).alias("held_out"), "score", "predicted")


def keep_predicted(docs: DataFrame, field: QualityField) -> DataFrame:
    """The rows predicted good, with all their columns."""

    def keep(chunk: pa.RecordBatch) -> pa.RecordBatch:
        scores = field.document_scores(lines(chunk.column("text")))
        return chunk.filter(pa.array(scores >= THRESHOLD))

    return map_arrow(docs, map_chunks(keep), docs.schema)
