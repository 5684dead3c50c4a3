"""Secret scans: rules, and a character convolutional network over every candidate in its context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import sliced, staged

# The rules' patterns, shortest lengths, and order of kinds.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SHORTEST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "learned")

_ASSIGN = re.compile(ASSIGN, re.I | re.A)
# A run that is too short fails whole, so asking for its least length at once finds the same runs.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=@-])[A-Za-z0-9+/_.=@-]{12,}")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[A-Za-z]{9,}")

# The network reads windows of LEFT characters before and WIDTH from the start of
# a candidate; a longer candidate is read by further windows to its end.
LEFT, WIDTH = 32, 72
ALPHABET = 130  # ASCII, other, outside the text
DIM, FILTERS, SPAN = 10, 24, 5

# All findings train the network, in lots of about so many. Those of the rarer label
# are dealt to several lots, until they are a fifth of each or each lot has them all.
FINDINGS_PER_LOT = 8192
LEAST_RECALL = 0.99
# Logits are rounded down to steps, so that counting their values loses nothing.
STEPS, FARTHEST = 1024, 64
# Weights of lots are added as whole numbers, whose sum no order changes.
WHOLE = 1 << 32

Spot = tuple[str, int, int]


def base_spans(text: str) -> list[Spot]:
    """Leftmost non-overlapping matches of each rule, by start and kind."""
    found: list[Spot] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(spot: Spot) -> tuple:
    return spot[1], KINDS.index(spot[0]), spot[2]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of 12 or more characters of keys, digests and addresses with a digit, or of 24 or more without."""
    return [m.span() for m in _TOKEN.finditer(text) if m.end() - m.start() >= 24 or _DIGIT.search(m[0])]


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Character classes, and from ALPHABET on a mark, of the windows over a candidate."""
    rows = []
    for at in range(start, end, WIDTH):
        part = text[max(0, at - LEFT) : at + WIDTH]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.full(LEFT + WIDTH, ALPHABET - 1, dtype=np.int64)
        offset = LEFT - (at - max(0, at - LEFT))
        row[offset : offset + len(codes)] = np.minimum(codes, 128)
        row[LEFT - min(LEFT, at - start) : LEFT + min(WIDTH, end - at)] += ALPHABET
        rows.append(row)
    return np.stack(rows)


def parts(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """The windows over a candidate, at most 64 at once."""
    for at in range(start, end, 64 * WIDTH):
        yield windows(text, at, min(end, at + 64 * WIDTH))


@dataclass
class Network:
    """Embedding, one convolution with rectifier, largest value over positions, one output."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    scale: np.ndarray
    threshold: float = 1.0

    @classmethod
    def new(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.3, (2 * ALPHABET, DIM)),
            rng.normal(0, (2 / (SPAN * DIM)) ** 0.5, (SPAN * DIM, FILTERS)),
            np.zeros(FILTERS),
            rng.normal(0, 0.3, FILTERS),
            np.zeros(1),
            np.asarray([1.0, 0.0]),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.bias, self.out, self.out_bias]

    def forward(self, rows: np.ndarray):
        looked = self.embed[rows]
        n, length, _ = looked.shape
        cols = np.concatenate([looked[:, i : length - SPAN + 1 + i] for i in range(SPAN)], axis=2)
        hidden = np.maximum(cols @ self.kernel + self.bias, 0)
        best = hidden.argmax(axis=1)
        pooled = np.take_along_axis(hidden, best[:, None, :], axis=1)[:, 0]
        return pooled @ self.out + self.out_bias[0], (cols, best, pooled)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def take(self, flat: np.ndarray) -> None:
        """Set all weights to what ``flat`` holds in its order."""
        ends = np.cumsum([w.size for w in self.weights()])
        for w, new in zip(self.weights(), np.split(flat, ends[:-1]), strict=True):
            w[...] = new.reshape(w.shape)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The logits of windows in steps of 1 / STEPS."""
        return np.floor(np.clip(self.forward(rows)[0], -FARTHEST, FARTHEST) * STEPS) / STEPS

    def gradients(self, rows: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean loss of windows, each times its share."""
        logits, (cols, best, pooled) = self.forward(rows)
        d_logit = shares * (1 / (1 + np.exp(-logits)) - labels) / len(labels)
        d_pooled = np.outer(d_logit, self.out) * (pooled > 0)
        at = np.arange(len(rows))[:, None]
        picked = cols[at, best]  # rows x filters x span*dim
        d_kernel = np.einsum("nfk,nf->kf", picked, d_pooled)
        d_cols = d_pooled[:, :, None] * self.kernel.T[None]
        d_embed = np.zeros_like(self.embed)
        for i in range(SPAN):
            np.add.at(d_embed, rows[at, best + i], d_cols[:, :, i * DIM : (i + 1) * DIM])
        return [d_embed, d_kernel, d_pooled.sum(axis=0), pooled.T @ d_logit, np.asarray([d_logit.sum()])]

    def logits(self, texts: list[tuple[str, int, int]]) -> np.ndarray:
        """The largest logit over each candidate's windows."""
        out = np.full(len(texts), -np.inf)
        rows, owner = [], []

        def flush():
            if rows:
                np.maximum.at(out, np.concatenate(owner), self.score(np.concatenate(rows)))
                rows.clear(), owner.clear()

        for i, (text, start, end) in enumerate(texts):
            for part in parts(text, start, end):
                rows.append(part)
                owner.append(np.full(len(rows[-1]), i))
                if sum(map(len, owner)) >= 256:
                    flush()
        flush()
        return out

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -40, 40)))


def labelled(text: str) -> Iterator[tuple[int, int, bool]]:
    """What the network learns from in a text, and whether it lies in what the rules find there.

    These are its candidates, the rules' spans, and its first long word as an
    example of plain text, so that every text with words gives one.
    """
    base = base_spans(text)
    word = _WORD.search(text)
    reach, at = 0, 0
    for start, end in sorted({*candidates(text), *((s, e) for _, s, e in base), *([word.span()] if word else [])}):
        while at < len(base) and base[at][1] <= start:
            reach = max(reach, base[at][2])
            at += 1
        yield start, end, end <= reach


def findings(docs: DataFrame) -> DataFrame:
    """Every window that the network reads of what ``labelled`` names in all texts.

    Returns window (its character classes), hit, and n, how often it occurs.
    """
    names = ["window", "hit"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[bytes] = []
            hits: list[bool] = []
            for text in batch.column(0).to_pylist():
                for start, end, hit in labelled(text or ""):
                    for part in parts(text, start, end):
                        rows += [row.tobytes() for row in part.astype("<u2")]
                        hits += [hit] * len(part)
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(hits, pa.bool_())], names=names)
                            rows, hits = [], []
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(hits, pa.bool_())], names=names)

    return docs.select("text").mapInArrow(read, "window binary, hit boolean").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def _windows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, LEFT + WIDTH)


def descend(net: Network, rows: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> None:
    """Adam over all ``rows`` once, in batches of about 32; both labels weigh the same."""
    shares = np.where(labels == 1, *(len(labels) / (2 * max(1, (labels == x).sum())) for x in (1, 0)))
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    for step, batch in enumerate(np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 32)), 1):
        for w, g, m, v in zip(net.weights(), net.gradients(rows[batch], labels[batch], shares[batch]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def train(found: DataFrame, epochs: int = 6, seed: int = 7, recall: float = LEAST_RECALL, per_lot: int = FINDINGS_PER_LOT) -> Network | None:
    """Train on four fifths of ``findings``; calibrate and set the threshold on the rest.

    A hash of the window decides the fifth. In each epoch every lot of the
    others goes on from the same weights, and the mean of what the lots come to
    is where the next epoch starts. Equal windows of one label train once.

    Calibration fits a slope and an offset of the logit to the labels, which
    weigh the same. The threshold is the largest probability that still finds
    ``recall`` of the positive occurrences. The driver sees weights and the
    counts of logits, never findings. Neither order nor partitions of
    ``found`` change the result. None without findings of both labels in both
    parts.
    """
    later = F.pmod(F.xxhash64(F.lit("later"), "window"), F.lit(5)) == 4
    sizes = {(r["later"], r["hit"]): r["count"] for r in found.groupBy(later.alias("later"), "hit").count().collect()}
    if len(sizes) < 4:
        return None
    yes, no = sizes[False, True], sizes[False, False]
    lots = -(-(yes + no) // per_lot)
    times = min(lots, -(-max(yes, no) // (4 * min(yes, no))))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("hit") == F.lit(yes < no), times - 1).otherwise(0)))
    dealt = found.filter(~later).select("window", "hit", copies.alias("copy"))
    lot = F.pmod(F.xxhash64(F.lit("lot"), "window") + F.col("copy"), F.lit(lots))
    dealt = dealt.select(lot.alias("lot"), "window", "hit")
    net = Network.new(seed)

    def learn(epoch: int, net: Network):
        def one(group: pa.Table) -> pa.Table:
            group = group.sort_by([("window", "ascending"), ("hit", "ascending")])
            rng = np.random.default_rng([seed, epoch, group.column("lot")[0].as_py()])
            descend(net, _windows_of(group.column("window")), group.column("hit").to_numpy().astype(float), rng)
            return pa.table({"weights": pa.array([np.rint(net.flat() * WHOLE).astype(np.int64)], pa.list_(pa.int64()))})

        return one

    for epoch in range(epochs):
        made = dealt.groupBy("lot").applyInArrow(learn(epoch, net), "weights array<long>")
        sums = made.select(F.posexplode("weights").alias("at", "w")).groupBy("at").agg(F.sum("w").alias("w"), F.count("w").alias("lots"))
        net.take(np.asarray([r["w"] / r["lots"] / WHOLE for r in sorted(sums.collect(), key=lambda r: r["at"])]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if len(batch):
                logits = pa.array(net.score(_windows_of(batch.column(0))), pa.float64())
                yield pa.RecordBatch.from_arrays([logits, batch.column(1), batch.column(2)], names=["logit", "hit", "n"])

    judged = found.filter(later).select("window", "hit", "n").mapInArrow(judge, "logit double, hit boolean, n long")
    counted = judged.groupBy("logit", "hit").agg(F.sum("n").alias("n")).orderBy("logit", "hit").collect()
    calibrate(net, *(np.asarray([r[c] for r in counted], dtype=float) for c in ("logit", "hit", "n")), recall)
    return net


def calibrate(net: Network, logits: np.ndarray, truth: np.ndarray, n: np.ndarray, recall: float) -> None:
    """Slope, offset and threshold from how often each logit was that of each label."""
    share = n / np.where(truth == 1, *(2 * n[truth == x].sum() for x in (1, 0)))
    for _ in range(200):
        miss = share * (net.probability(logits) - truth)
        net.scale -= 0.5 * np.asarray([(miss * logits).sum() / max(1.0, (share * logits**2).sum()), miss.sum()])
    chance, hits = net.probability(logits[truth == 1]), n[truth == 1]
    order = np.argsort(chance)
    passed = np.cumsum(hits[order])
    net.threshold = float(chance[order][np.searchsorted(passed, np.floor((1 - recall) * passed[-1]), "right")])


def fit(docs: DataFrame) -> Network | None:
    """Train, calibrate and set the threshold on the findings of all rows and whole texts of ``docs``.

    Null and empty texts teach nothing; an empty table gives None.
    """
    return train(staged(findings(docs), "findings"))


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_learned long, top_score double"
)


def joined(spots: list[Spot]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spots, key=_order))


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """Secrets in every whole text of ``docs`` (doc_id, text), a row per row.

    n_assign, n_access, n_hex count what the rules find; base_sha256 digests
    those spans (kind:start:end in code points by start, comma-joined). The
    network scores every candidate in its context; one that no rule covers and
    whose calibrated probability reaches the threshold is added as ``learned``.
    ``spans`` lists all, top_score is the largest probability of a candidate
    (null without one, or where there was nothing to train on).

    Null and empty texts have no spans. Each row stands on its own, so repeated
    rows give equal rows and an empty table none.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            spots = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t)]
            learned: list[list[Spot]] = [[] for _ in texts]
            top: list[float | None] = [None] * len(texts)
            if net is not None and spots:
                scores = net.probability(net.logits([(texts[i], s, e) for i, s, e in spots]))
                for (i, start, end), score in zip(spots, scores.tolist(), strict=True):
                    top[i] = max(score, top[i] or 0.0)
                    if score >= net.threshold and not any(s < end and start < e for _, s, e in base[i]):
                        learned[i].append(("learned", start, end))
            count = lambda kind: pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64())
            columns = [
                batch.column(0),
                *map(count, SHORTEST),
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                pa.array([joined(b + more) for b, more in zip(base, learned, strict=True)], pa.string()),
                pa.array(list(map(len, learned)), pa.int64()),
                pa.array(top, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, SCHEMA)
