"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairs cost linear time, because their sum
is half of sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2.

Words are weighted by the logarithm of their count and scaled to unit length; statistics are standardised. The model
is fitted on the driver from a bounded sample: SAMPLE labelled rows, the first by a hash of their id.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.words import Memo, fold, with_columns

BUCKETS = 1 << 12
FACTORS = 8
SAMPLE = 8192
EPOCHS = 12
RATE = 0.03
BATCH = 128
SHRINK = 1e-4
SPACE = b" \t\n\x0b\x0c\r"
DIGITS, UPPER = bytes(range(48, 58)), bytes(range(65, 91))
SYMBOLS, STOPS = b"#*$%&|<>=+^~@\\{}[]", b".,;:!?"
HIGH = bytes(range(128, 256))
STATS = 14
_BUCKET = Memo(lambda word: xxhash.xxh3_64_intdigest(word) % BUCKETS)


def describe(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, statistics) of one text; null is described as the empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    size, count = max(len(raw), 1), max(len(words), 1)
    seen = Counter(words)
    total: dict[int, int] = {}
    for word, n in seen.items():
        bucket = _BUCKET[word]
        total[bucket] = total.get(bucket, 0) + n
    buckets = np.fromiter(total, np.int64, len(total))
    weights = np.log1p(np.fromiter(total.values(), np.float64, len(total)))
    weights /= max(float(np.sqrt((weights**2).sum())), 1e-9)
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]

    def share(kind: bytes) -> float:
        return (len(raw) - len(raw.translate(None, kind))) / size

    symbols = share(SYMBOLS)
    stats = np.array([
        symbols, np.sqrt(symbols), share(DIGITS), share(UPPER), share(STOPS), share(HIGH), share(SPACE),
        size / count, len(seen) / count, max(seen.values(), default=0) / count, len(set(lines)) / max(len(lines), 1),
        np.log1p(size / max(len(lines), 1)), np.log1p(len(words)),
        np.log1p(max(n_chars if n_chars is not None else len(text or ""), 0)),
    ])
    return buckets, weights, stats


@dataclass
class Machine:
    """Weights of a fitted factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[float]:
        out = []
        for buckets, weights, stats in rows:
            dense = np.clip((stats - self.mean) / self.scale, -6, 6)
            x = np.concatenate([weights, dense])
            at = np.concatenate([buckets, np.arange(BUCKETS, BUCKETS + STATS)])
            inner = x[:, None] * self.factors[at]
            y = self.bias + x @ self.linear[at] + 0.5 * float((inner.sum(0) ** 2 - (inner**2).sum(0)).sum())
            out.append(float(1 / (1 + np.exp(-np.clip(y, -30, 30)))))
        return out


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Fit by Adam on the logistic loss. Without rows every score is 0.5."""
    width, rng = BUCKETS + STATS, np.random.default_rng(7)
    linear, factors = np.zeros(width), rng.normal(0, 0.01, (width, FACTORS))
    if not rows:
        return Machine(0.0, linear, factors * 0, np.zeros(STATS), np.ones(STATS))
    stats = np.array([r[2] for r in rows])
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    stats = np.clip((stats - mean) / scale, -6, 6)
    base = np.clip(labels.mean(), 0.01, 0.99)
    state = [np.array(np.log(base / (1 - base))), linear, factors]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            x = np.zeros((len(pick), width))
            for i, k in enumerate(pick):
                x[i, rows[k][0]] = rows[k][1]
            x[:, BUCKETS:] = stats[pick]
            inner, square = x @ state[2], x * x
            y = state[0] + x @ state[1] + 0.5 * (inner**2 - square @ state[2] ** 2).sum(1)
            miss = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[pick]) / len(pick)
            slopes = [
                np.array(miss.sum()),
                x.T @ miss + SHRINK * state[1],
                x.T @ (miss[:, None] * inner) - (square.T @ miss)[:, None] * state[2] + SHRINK * state[2],
            ]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                state[i] = state[i] - RATE * move
    return Machine(float(state[0]), state[1], state[2], mean, scale)


def _described(docs: DataFrame, identity: str, text: str, n_chars: str) -> DataFrame:
    size = F.col(n_chars).cast("long") if n_chars in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(identity).alias("id"), size.alias("size"), F.col(text).alias("text"))


def train(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Machine:
    """The machine fitted on at most `sample` labelled documents whose fold (crc32 of the id mod 3) is not 1.

    Labels null in either column are not used; of several labels of one id the smallest counts.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col(identity).isNotNull())
        .groupBy(F.col(identity).alias("label_id")).agg(F.min("quality").alias("label"))
        .filter(fold("label_id") % 3 != 1)
        .orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    )
    labelled = _described(docs, identity, text, "n_chars").join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    # An id may be repeated without end: of its rows the one of the smallest digest is learned from.
    first = F.min(F.struct(F.xxhash64("text").alias("digest"), "label", "size", "text")).alias("row")
    picked = labelled.groupBy("id").agg(first).select("id", "row.*")
    got = sorted(
        with_columns(
            picked.select("id", "label", "size", "text"), "text", "b BINARY, w BINARY, s BINARY",
            lambda texts: dict(zip("bws", zip(*[[p.tobytes() for p in describe(t, None)] for t in texts]))),
        ).select("id", "label", "size", "b", "w", "s").collect(),
        key=lambda r: (r.id, bytes(r.s)),
    )
    rows = []
    for r in got:
        stats = np.frombuffer(r.s).copy()
        if r.size is not None:
            stats[-1] = np.log1p(max(r.size, 0))
        rows.append((np.frombuffer(r.b, np.int64), np.frombuffer(r.w), stats))
    return fit_machine(rows, np.array([float(r.label > 0) for r in got]))


def score_documents(docs: DataFrame, machine: Machine, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """(identity, held_out, score, predicted) of every row of `docs`.

    Null and empty texts are scored by their statistics; n_chars counts where it is there and not null, else the
    text's length. A null id has the fold of the empty text. Repeated rows each give a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        import pyarrow as pa

        from shelfspark.llm.words import claim, slices

        claim(_BUCKET)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, sizes = batch.column("text").to_pylist(), batch.column("size").to_pylist()
                scores = shared.value.scores([describe(t, n) for t, n in zip(texts, sizes)])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    rows = _described(docs, identity, text, "n_chars")
    from pyspark.sql.types import DoubleType, StructType

    scored = rows.mapInArrow(run, StructType([rows.schema["id"]]).add("score", DoubleType()))
    return scored.select(
        F.col("id").alias(identity), (fold("id") % 3 == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows of `docs` that the machine does not reject, with their columns as they were.

    Null and empty texts hold nothing to learn from and are rejected by their score like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        from shelfspark.llm.words import claim, slices

        claim(_BUCKET)
        for whole in batches:
            for batch in slices(whole, text):
                sizes = batch.column("n_chars").to_pylist() if "n_chars" in columns else [None] * batch.num_rows
                scores = shared.value.scores([describe(t, n) for t, n in zip(batch.column(text).to_pylist(), sizes)])
                yield batch.filter(pa.array([s >= 0.5 for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
