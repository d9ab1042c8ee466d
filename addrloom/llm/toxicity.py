"""Toxic words tagged by a linear-chain conditional random field, documents scored by its marginals.

Labels exist for documents, tags are needed for words: in a sample of labelled documents a word counts as
toxic where its document does and one of its features (the word itself or a beginning of it) occurs
in toxic documents, after different words, far beyond chance.  The field learns these tags sentence by sentence from hashed features of
beginnings and endings, so it tags words it never saw.  Forward and backward passes give every word its
probability; a logistic function of a document's greatest and summed probabilities, fitted on other sample
documents and brought to the share of toxic labels, is its score.

The fitted arrays have a fixed size and are broadcast.  Scoring is row-local and reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from addrloom.llm.arrowtext import pieces
from addrloom.llm.letters import PartHashes, letter_runs
from addrloom.llm.shared import crc32, first_share

# bounds of the training sample, per label
SAMPLE_DOCUMENTS, SAMPLE_TEXT_BYTES = 1500, 1 << 15
BUCKETS_BITS = 18
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
# a feature is a sign of toxicity from these log odds and likelihood ratio on
LOG_ODDS, RATIO = 2.5, 25.0
EPOCHS, BATCH, RATE, DECAY = 6, 512, 0.3, 1e-5
TAGGED = 0.5
THRESHOLD = 0.7

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in "\n.!?"]] = True


# -- words, features, sentences ----------------------------------------------------------------

class Words:
    """The words of some rows: bytes, rows, hashed features (0 where a word is too short) with the ``marks`` that
    tell features of one bucket apart, and sentences."""

    def __init__(self, data: np.ndarray, at: np.ndarray, hasher: PartHashes) -> None:
        small, self.starts, self.ends, self.row = letter_runs(data, at)
        sums, n = hasher.sums(small), len(self.starts)
        length = self.ends - self.starts
        columns = [(hasher.of(sums, self.starts, self.ends), np.ones(n, bool), 1)]
        columns += [(hasher.of(sums, self.starts, np.minimum(self.starts + k, self.ends)), length >= k, 10 + k) for k in PREFIXES]
        columns += [(hasher.of(sums, np.maximum(self.ends - k, self.starts), self.ends), length >= k, 20 + k) for k in SUFFIXES]
        self.features, self.marks = np.zeros((n, len(columns)), np.int32), np.zeros((n, len(columns)), np.uint16)
        for i, (h, valid, salt) in enumerate(columns):
            mixed = (h + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
            bucket = (mixed >> np.uint64(64 - BUCKETS_BITS)).astype(np.int32)
            self.features[:, i] = np.where(valid, np.maximum(bucket, 1), 0)
            self.marks[:, i] = (mixed >> np.uint64(20)).astype(np.uint16)
        # a sentence ends at a line, at . ! ? and with its row
        breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
        new = np.ones(n, bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (breaks[self.starts[1:]] != breaks[self.ends[:-1]])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, n))

    def known(self, owner: np.ndarray) -> np.ndarray:
        """The features that own their bucket; the others, which training never saw there, become 0."""
        return np.where(owner[self.features] == self.marks, self.features, 0)

    def owners(self, tags: np.ndarray) -> np.ndarray:
        """Per bucket the mark of one feature, one of a tagged word where there is one."""
        owner = np.zeros(1 << BUCKETS_BITS, np.uint16)
        for some in (tags == 0, tags == 1):
            owner[self.features[some].ravel()] = self.marks[some].ravel()
        return owner


# -- the field ---------------------------------------------------------------------------------

def marginals(score: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray, begin: np.ndarray, expect: bool = False):
    """Probability of tag 1 for every word, by forward and backward passes over all sentences together.

    ``score`` is each word's advantage of tag 1 over tag 0, ``trans[i, j]`` the advantage of j after i, ``begin``
    that of a first tag.  With ``expect`` also the expected number of each transition and each first tag.
    """
    n = len(score)
    emit = np.ones((n, 2))
    emit[:, 1] = np.exp(np.clip(score, -30, 30))
    step, start = np.exp(trans), np.exp(begin)
    order = np.argsort(-size, kind="stable")
    heads, lengths = first[order], size[order]
    alpha, scale, beta = np.empty((n, 2)), np.empty(n), np.ones((n, 2))
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # sentences longer than t
    for t in range(longest):
        at = heads[: active[t]] + t
        a = (np.broadcast_to(start, (len(at), 2)) if t == 0 else alpha[at - 1] @ step) * emit[at]
        total = a[:, 0] + a[:, 1]
        alpha[at], scale[at] = a / total[:, None], total
    counts = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = heads[: active[t]] + t
        ahead = emit[at] * beta[at] / scale[at][:, None]
        if expect:
            counts += step * (alpha[at - 1].T @ ahead)
        beta[at - 1] = ahead @ step.T
    both = alpha * beta
    p = both[:, 1] / (both[:, 0] + both[:, 1])
    return (p, counts, np.array([(1 - p[first]).sum(), p[first].sum()])) if expect else p


@dataclass(frozen=True)
class Model:
    """``weights`` of the features and the ``owner`` of each, the chain's ``trans`` and ``begin``, and the ``document`` weights (constant,
    greatest marginal, logarithm of the sum)."""

    weights: np.ndarray
    owner: np.ndarray
    trans: np.ndarray
    begin: np.ndarray
    document: np.ndarray

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.weights, self.owner, self.trans, self.begin, self.document


def weak_tags(words: Words, toxic: np.ndarray) -> np.ndarray:
    """1 for the words of toxic rows with a feature that marks toxic rows.

    A feature counts once per different word before it, so what copies and near-copies of a text
    repeat counts once.
    """
    in_toxic = toxic[words.row]
    n_toxic, n_clean = int(in_toxic.sum()), int((~in_toxic).sum())
    share = min(max(n_toxic / max(n_toxic + n_clean, 1), 1e-9), 1 - 1e-9)
    told = np.zeros(len(words.row), bool)
    exact = (words.features.astype(np.int64) << 16) | words.marks
    before = np.zeros(len(words.row), np.int64)
    same = words.row[1:] == words.row[:-1]
    before[1:][same] = words.features[:-1, 0][same]
    for i in [0, *range(1 + PREFIXES.index(4), 1 + len(PREFIXES))]:
        _, which = np.unique(exact[:, i], return_inverse=True)
        n = int(which.max()) + 1 if len(which) else 0
        pair = (which.astype(np.int64) << BUCKETS_BITS) | before
        t = np.bincount(np.unique(pair[in_toxic]) >> BUCKETS_BITS, minlength=n).astype(float)
        c = np.bincount(np.unique(pair[~in_toxic]) >> BUCKETS_BITS, minlength=n).astype(float)
        odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
        total = np.maximum(t + c, 1)
        part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(k, 1) / (total * q)), 0)
        sign = (odds >= LOG_ODDS) & (2 * (part(t, share) + part(c, 1 - share)) >= RATIO)
        told |= sign[which] & (words.features[:, i] > 0)
    return (told & in_toxic).astype(np.int8)


def train_field(words: Words, tags: np.ndarray, owner: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights that make the tags likely: gradient steps with per-weight rates over batches of sentences."""
    rng, known = np.random.default_rng(seed), words.known(owner)
    tagged = np.add.reduceat(tags, words.first) > 0 if len(words.first) else np.zeros(0, bool)
    positive, negative = np.flatnonzero(tagged), np.flatnonzero(~tagged)
    negative = rng.permutation(negative)[: 4 * len(positive) + 2000]
    chosen = np.concatenate((positive, negative))
    weights, trans, begin = np.zeros(1 << BUCKETS_BITS), np.zeros((2, 2)), np.zeros(2)
    power = [np.full_like(x, 1e-3) for x in (weights, trans, begin)]
    for _ in range(EPOCHS):
        order = rng.permutation(chosen)
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            size = words.size[some]
            first = np.cumsum(size) - size
            at = np.repeat(words.first[some] - first, size) + np.arange(int(size.sum()))
            features, said = known[at], tags[at].astype(np.int64)
            p, steps, starts = marginals(weights[features].sum(axis=1), first, size, trans, begin, expect=True)
            inner = np.ones(len(at), bool)
            inner[first] = False
            pairs = np.bincount(2 * said[:-1][inner[1:]] + said[1:][inner[1:]], minlength=4).reshape(2, 2)
            touched = np.unique(features)
            change = np.bincount(features.ravel(), np.repeat(p - said, features.shape[1]), minlength=len(weights))[touched]
            change += DECAY * len(some) * weights[touched]
            power[0][touched] += change * change
            weights[touched] -= RATE * change / np.sqrt(power[0][touched])
            weights[0] = 0.0
            for x, g, s in ((trans, steps - pairs, 1), (begin, starts - np.bincount(said[first], minlength=2), 2)):
                power[s] += g * g
                x -= RATE * g / np.sqrt(power[s])
    return weights.astype(np.float32), trans, begin


def document_features(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Constant, greatest marginal, log of 1 and the summed marginals; 0 for rows without words."""
    top = np.zeros(rows)
    np.maximum.at(top, row, p)
    return np.stack((np.ones(rows), top, np.log1p(np.bincount(row, p, rows))), axis=1)


def train_document(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = decay * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = _logistic(x @ w)
        gradient = x.T @ (weight * (p - toxic)) + penalty @ w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


# -- fitting and applying on Spark -------------------------------------------------------------

def fit(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
) -> Model | None:
    """Fitted on a bounded sample: per label ``SAMPLE_DOCUMENTS`` documents of at most ``SAMPLE_TEXT_BYTES``,
    chosen by the checksum of their id, half for the tags and half for the document weights.

    Null ids, labels and texts teach nothing; an id with both labels counts as toxic; a text is used once.
    None if either label is missing.
    """
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("toxic"))
    known = known.where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(shares) < 2:
        return None
    known = known.withColumn("sum", crc32(F.col("id")))
    share = first_share(SAMPLE_DOCUMENTS, F.when(F.col("toxic") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0])))
    turn = Window.partitionBy("toxic").orderBy("sum", "id")
    # a bounded number of rows, so it may be broadcast
    chosen = known.where(F.col("sum") < share * float(1 << 32)).withColumn("nth", F.row_number().over(turn))
    chosen = chosen.where(F.col("nth") <= SAMPLE_DOCUMENTS).select("id", "toxic")
    texts = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    texts = texts.where("text is not null").where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    rows = texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).collect()
    rows = sorted({r["text"]: (str(r["id"]), r["toxic"], r["text"]) for r in rows}.values())
    rng = np.random.default_rng(0)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    toxic = np.array([r[1] == 1 for r in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    hasher = PartHashes()

    def words(part: list) -> Words:
        said = [r[2].encode() for r in part]
        return Words(np.frombuffer(b"".join(said), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in said]))).astype(np.int64), hasher)

    half = len(rows) // 2
    taught, judged = words(rows[:half]), words(rows[half:])
    tags = weak_tags(taught, toxic[:half])
    owner = taught.owners(tags)
    weights, trans, begin = train_field(taught, tags, owner)
    p = marginals(weights[judged.known(owner)].sum(axis=1), judged.first, judged.size, trans, begin)
    x, seen = document_features(p, judged.row, len(rows) - half), toxic[half:]
    sample = np.bincount(seen.astype(int), minlength=2)
    real = np.array([shares[0], shares[1]]) / (shares[0] + shares[1])
    weight = (real * len(seen) / np.maximum(sample, 1))[seen.astype(int)]
    return Model(weights, owner, trans, begin, train_document(x, seen.astype(float), weight))


def score(documents: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """``document`` (a struct of the carried columns), ``score`` (0 to 1), ``n_toxic`` (tagged words) and ``spans``
    (runs of tagged words as [start, end) code points).

    A null text, an empty one and one without words get the score of a text without any sign.  Without a
    model every score is 0.  Whole texts are read; repeated rows are scored alike.
    """
    rows = documents.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("document"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )
    span = "array<struct<start: int, end: int>>"
    schema = rows.select("document", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_toxic"), F.expr(f"cast(array() as {span})").alias("spans")).schema
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    arrays = documents.sparkSession.sparkContext.broadcast(model.arrays() if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, fitted = PartHashes(), arrays.value
        for batch in batches:
            for piece, data, at in pieces(batch, "text"):
                n = piece.num_rows
                scores, tagged, spans = np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
                if fitted is not None:
                    weights, owner, trans, begin, document = fitted
                    words = Words(data, at, hasher)
                    p = marginals(weights[words.known(owner)].sum(axis=1), words.first, words.size, trans, begin)
                    scores = _logistic(document_features(p, words.row, n) @ document)
                    hits = np.flatnonzero(p >= TAGGED)
                    tagged = np.bincount(words.row[hits], minlength=n)
                    for r in np.unique(words.row[hits]).tolist():
                        here = hits[words.row[hits] == r]
                        # code points before a byte: bytes that do not continue a character
                        points = np.concatenate(([0], np.cumsum((data[at[r] : at[r + 1]] & 0xC0) != 0x80)))
                        last = np.flatnonzero(np.diff(here, append=-1) != 1)
                        head = np.concatenate(([0], last[:-1] + 1))
                        spans[r] = [
                            {"start": int(points[words.starts[a] - at[r]]), "end": int(points[words.ends[b] - at[r]])}
                            for a, b in zip(here[head].tolist(), here[last].tolist())
                        ]
                columns = [piece.column("document"), pa.array(scores), pa.array(tagged, pa.int64()), pa.array(spans, span_type)]
                yield pa.RecordBatch.from_arrays(columns, names=["document", "score", "n_toxic", "spans"])

    return rows.mapInArrow(run, schema)
