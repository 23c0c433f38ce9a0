"""Secret scan: patterns of fixed form, and a character convolutional network over every candidate.

The fixed patterns find assignments to secret-like names, access keys and long hex strings. Candidates are these, the assignments and keys
that fail for their length, every token of 8 characters or more with a digit and every one of 16 or more; each is read with its surrounding characters
by a small convolutional network in numpy. The network learns from labelled findings: the fixed matches are positive, the tokens
negative; failed matches have no label and are only scored. Half of the positives' contexts are blanked and half of their bodies cut to
8 characters or more, so that the token itself has to be judged at any length. Its threshold is calibrated on held-back findings: ``RECALL`` of the positives
stay above it, and it lies in the middle of the gap below them, where there is one; the precision that it has there is kept beside it. A candidate of more than ``BODY`` characters is read in windows of
``BODY`` characters, ``STEP`` apart and one at its end, and has the highest score of them. Candidates above the threshold are added; fixed matches always stay.

``MAX_LABELLED`` bounds the findings that are learned from (in the order of a hash); every candidate of all documents is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, text_or_empty
from .spans import joined, labelled, with_matches

KINDS = ["assign", "access", "hex"]
MAX_LABELLED, RECALL = 20_000, 0.98
LEFT, BODY, RIGHT = 24, 48, 8
#: So that any BODY - STEP + 1 characters in a row lie in a window.
STEP = 8
WIDTH = LEFT + BODY + RIGHT
FILTERS, TAPS, HIDDEN, EPOCHS = 24, 5, 16, 12

#: Fixed values of the contract.
ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{8,}+|[A-Za-z0-9+/_=-]{16,}+)"


def base_matches(docs: DataFrame) -> DataFrame:
    """Add an array column for each kind, ``weak``: matches that fail for their length, and ``other``: tokens that touch none of those.

    The context of an assignment holds its name, its body the value alone; the places are those of the whole match.
    """
    df = docs.withColumn("__t", text_or_empty())
    value = f"regexp_extract(m.h, r'{ASSIGN}', 1)"
    df = with_matches(df, "assign", ASSIGN, "__t", left=LEFT, right=RIGHT)
    df = df.withColumn("assign", F.expr(f"transform(transform(assign, m -> named_struct('m', m, 'v', {value})), x -> named_struct('s', x.m.s, 'e', x.m.e, 'h', x.v, 'l', right(concat(x.m.l, left(x.m.h, length(x.m.h) - length(x.v))), {LEFT}), 'r', x.m.r))"))
    df = with_matches(df, "access", "AKIA[A-Z0-9]+", "__t", gate="A", left=LEFT, right=RIGHT)
    df = df.withColumn("weak", F.expr("concat(filter(assign, m -> length(m.h) < 12), filter(access, m -> length(m.h) < 18))"))
    df = df.withColumn("assign", F.expr("filter(assign, m -> length(m.h) >= 12)")).withColumn("access", F.expr("filter(access, m -> length(m.h) >= 18)"))
    df = with_matches(df, "hex", HEX, "__t", left=LEFT, right=RIGHT)
    df = with_matches(df, "other", CANDIDATE, "__t", left=LEFT, right=RIGHT)
    for kind in KINDS:
        df = df.withColumns({c: F.expr(f"filter({c}, o -> not exists({kind}, m -> m.s < o.e and o.s < m.e))") for c in ("weak", "other")})
    return df.withColumn("other", F.expr("filter(other, o -> not exists(weak, m -> m.s < o.e and o.s < m.e))")).drop("__t")


_CLASS = np.full(128, 12, np.int64)
for _i, _chars in enumerate(["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", " \t\n\r", "\"'`", ":=", "+/", "_-", ".", "@"]):
    _CLASS[[ord(c) for c in _chars]] = _i
CLASSES = 15  # those, other ASCII (12), other letters (13), padding (14); another channel marks the candidate


def encode(left: list[str], body: list[str], right: list[str], blank: np.ndarray | None = None) -> np.ndarray:
    """(n, WIDTH, CLASSES + 1) one-hot classes of the characters; of a body the first BODY characters are read (``windows`` cuts longer ones)."""
    codes = np.full((len(body), WIDTH), 14, np.int64)
    for i, (a, b, c) in enumerate(zip(left, body, right, strict=True)):
        a = "" if blank is not None and blank[i] else a[-LEFT:]
        for start, part in ((LEFT - len(a), a), (LEFT, b[:BODY]), (LEFT + BODY, c[:RIGHT])):
            points = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
            codes[i, start : start + len(points)] = np.where(points < 128, _CLASS[np.minimum(points, 127)], 13)
    out = np.zeros((len(body), WIDTH, CLASSES + 1), np.float32)
    np.put_along_axis(out, codes[:, :, None], 1, axis=2)
    out[:, LEFT : LEFT + BODY, CLASSES] = codes[:, LEFT : LEFT + BODY] != 14
    return out


def windows(left: list[str], body: list[str], right: list[str]) -> tuple[np.ndarray, list[str], list[str], list[str]]:
    """The candidates' windows: whose each is, and the window with the candidate's own context, as the network knows it from training."""
    owner, out = [], ([], [], [])
    for i, (a, b, c) in enumerate(zip(left, body, right, strict=True)):
        last = max(0, len(b) - BODY)
        for s in [*range(0, last, STEP), last]:
            owner.append(i)
            for into, part in zip(out, (a, b[s : s + BODY], c), strict=True):
                into.append(part)
    return np.array(owner, np.int64), *out


@dataclass
class Network:
    conv: np.ndarray
    conv_bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    threshold: float = 2.0
    precision: float = float("nan")

    def parameters(self) -> list[np.ndarray]:
        return [self.conv, self.conv_bias, self.w1, self.b1, self.w2, self.b2]

    def forward(self, x: np.ndarray):
        n = len(x)
        windows = np.lib.stride_tricks.sliding_window_view(x, TAPS, axis=1).reshape(n, WIDTH - TAPS + 1, -1)
        maps = np.maximum(0, windows @ self.conv + self.conv_bias)
        pooled, at = np.concatenate((maps.max(axis=1), maps.mean(axis=1)), axis=1), maps.argmax(axis=1)
        hidden = np.maximum(0, pooled @ self.w1 + self.b1)
        return windows, maps, pooled, at, hidden, 1 / (1 + np.exp(-np.clip((hidden @ self.w2 + self.b2)[:, 0], -30, 30)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 1024])[-1] for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)


def score_candidates(net: Network, left: list[str], body: list[str], right: list[str], most: int = 4096) -> np.ndarray:
    """The highest score of each candidate's windows; ``most`` of them are encoded at once."""
    owner, *texts = windows(left, body, right)
    out = np.zeros(len(body))
    for i in range(0, len(owner), most):
        np.maximum.at(out, owner[i : i + most], net.scores(encode(*(x[i : i + most] for x in texts))))
    return out


def train(left: list[str], body: list[str], right: list[str], y: np.ndarray, seed: int = 3) -> Network:
    """Adam on the log loss. Without findings of both labels there is nothing to tell apart: the threshold then admits nothing."""
    rng = np.random.default_rng(seed)
    shape = [(TAPS * (CLASSES + 1), FILTERS), (FILTERS,), (2 * FILTERS, HIDDEN), (HIDDEN,), (HIDDEN, 1), (1,)]
    net = Network(*[rng.normal(0, np.sqrt(2 / s[0]), s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in shape])
    if len(np.unique(y)) < 2:
        return net
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    cut = (y > 0) & (rng.random(len(y)) < 0.5)
    cut[held] = False
    body = [b[: int(rng.integers(8, max(9, len(b) + 1)))] if c else b for b, c in zip(body, cut, strict=True)]
    x = encode(left, body, right, blank=(y > 0) & (rng.random(len(y)) < 0.5))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()], 0
    epochs = max(EPOCHS, min(60, 60_000 // len(y)))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            windows, maps, pooled, at, hidden, p = net.forward(x[part])
            error = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)[:, None]
            d_hidden = (error @ net.w2.T) * (hidden > 0)
            d_pooled = d_hidden @ net.w1.T
            d_maps = np.repeat(d_pooled[:, None, FILTERS:] / maps.shape[1], maps.shape[1], axis=1)
            i, j = np.indices(at.shape)
            d_maps[i, at, j] += d_pooled[:, :FILTERS]
            d_maps *= maps > 0
            gradients = [np.einsum("nwk,nwf->kf", windows, d_maps, optimize=True), d_maps.sum(axis=(0, 1)), pooled.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for w, g, (m, v) in zip(net.parameters(), gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.004 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # held-back findings are scored as candidates are: over all windows, the positives' contexts blanked as in x
    blank = (x[:, :LEFT, :14].sum(axis=(1, 2)) == 0)[held]
    score = score_candidates(net, ["" if b else left[i] for i, b in zip(held, blank, strict=True)], [body[i] for i in held], [right[i] for i in held])
    positive = np.sort(score[y[held] > 0])
    if not len(positive):  # too few findings to hold any back: those that were learned from set the threshold
        held, score = fit, score_candidates(net, [left[i] for i in fit], [body[i] for i in fit], [right[i] for i in fit])
        positive = np.sort(score[y[held] > 0])
    if len(positive):
        keeps = positive[int((1 - RECALL) * len(positive))]
        # nothing lies between that and the next negative below it: the middle, by log odds, has the same precision and no less recall
        below = score[(y[held] == 0) & (score < keeps)].max(initial=1e-6)
        middle = 1 / (1 + np.exp(-np.mean([np.log(p / (1 - p)) for p in np.clip([keeps, below], 1e-6, 1 - 1e-6)])))
        net.threshold = float(min(keeps, middle))
        net.precision = float((y[held][score >= net.threshold] > 0).mean())
    return net


def _candidates(found: DataFrame) -> DataFrame:
    parts = [f"transform({k}, m -> named_struct('base', {i}, 'm', m))" for i, k in enumerate(KINDS)] + ["transform(weak, m -> named_struct('base', -2, 'm', m))", "transform(other, m -> named_struct('base', -1, 'm', m))"]
    return found.select("__row", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x")).select("__row", "x.base", "x.m.*")


def fit(candidates: DataFrame, max_labelled: int = MAX_LABELLED) -> Network:
    """At most ``max_labelled`` findings of each label, distinct tokens with their contexts, in the order of a hash."""
    findings = candidates.where("base <> -2").select((F.col("base") >= 0).cast("int").alias("y"), "l", "h", "r").distinct()
    rows = []
    for label in (0, 1):
        rows += findings.where(F.col("y") == label).orderBy(F.xxhash64("l", "h", "r"), "h", "l", "r").limit(max_labelled).collect()
    return train([r.l for r in rows], [r.h for r in rows], [r.r for r in rows], np.array([r.y for r in rows], np.float32))


def find_secrets(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id with the arrays of fixed matches, ``found`` (s, k, e of candidates above the threshold, k = 3) and ``best`` (the highest score).

    Null and empty texts have no candidate. Rows that repeat an id are separate documents, a null id is kept; ids are of any type.
    Other columns are ignored. An empty table gives an empty table. Texts and candidates are read whole, however long.
    """
    found = checkpointed(base_matches(docs.select("doc_id", "text")).drop("text").withColumn("__row", F.monotonically_increasing_id()))
    candidates = _candidates(found)
    net = fit(candidates, max_labelled)
    schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField("base", T.IntegerType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def task(batches):
        for batch in batches:
            p = score_candidates(net, *(batch.column(i).to_pylist() for i in (5, 4, 6)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(p.astype(np.float64))], names=schema.names)

    scored = candidates.select("__row", "base", "s", "e", "h", "l", "r").mapInArrow(task, schema)
    taken = scored.groupBy("__row").agg(
        F.expr(f"array_sort(collect_list(if(base < 0 and score >= {net.threshold!r}D, named_struct('s', s, 'k', {len(KINDS)}, 'e', e), null)))").alias("found"), F.max("score").alias("best")
    )
    return found.join(taken, "__row", "left").withColumn("found", F.expr("coalesce(found, cast(array() as array<struct<s:int,k:int,e:int>>))"))


def op4_secrets(spark, sf_dir):
    """Secrets in every whole text of ``documents``; ``n_found`` spans come from the network."""
    from .common import documents

    found = find_secrets(documents(spark, sf_dir)).withColumn("__base", F.expr(labelled(KINDS)))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.expr(joined("__base", KINDS)), 256).alias("base_sha256"),
        F.expr(joined("array_sort(concat(__base, found))", [*KINDS, "model"])).alias("spans"), F.size("found").cast("long").alias("n_found"), "best",
    )
