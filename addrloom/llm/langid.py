"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads a run of letters forwards and backwards and names a language at every byte; a
document's probabilities are the mean over all bytes of all its runs.  A run's labels depend on the run
only, so a task labels each different run once and counts it as often as it occurs.  Runs above
``SEGMENT`` bytes are read in pieces of that length.  Training is backpropagation through time in numpy, on
a bounded sample of labelled words; the fitted arrays are a few kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from addrloom.llm.arrowtext import pieces
from addrloom.llm.letters import IS_LETTER, PartHashes, has_letter, letter_runs
from addrloom.llm.shared import first_share

UNKNOWN = "und"
HIDDEN = 12
SEGMENT = 64
# bounds of the training sample, per language
SAMPLE_DOCUMENTS, SAMPLE_WORDS, SAMPLE_TEXT_BYTES = 400, 5000, 1 << 16
EPOCHS, BATCH, RATE = 12, 256, 0.01
# a text is foreign where it has less than this part of the learned byte triples that held-out words have
FOREIGN = 0.6
# labelled runs a task remembers before it starts over
MEMORY = 1 << 19

Params = dict[str, np.ndarray]


# -- the network -------------------------------------------------------------------------------

def init(languages: int, hidden: int, seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    out = {"out_bias": np.zeros(languages, np.float32)}
    for d in ("fwd", "bwd"):
        out |= {f"{d}_in": draw(256, 3 * hidden), f"{d}_gates": draw(hidden, 2 * hidden), f"{d}_cand": draw(hidden, hidden), f"{d}_out": draw(hidden, languages)}
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(p: Params, d: str, ids: np.ndarray, keep: bool):
    """States after each byte, (length, words, hidden); with ``keep`` also what backpropagation needs."""
    n, length = ids.shape
    hidden = p[f"{d}_cand"].shape[0]
    state, states, saved = np.zeros((n, hidden), np.float32), np.empty((length, n, hidden), np.float32), []
    steps = range(length) if d == "fwd" else range(length - 1, -1, -1)
    for t in steps:
        x = p[f"{d}_in"][ids[:, t]]
        gates = _sigmoid(x[:, : 2 * hidden] + state @ p[f"{d}_gates"])
        update, reset = gates[:, :hidden], gates[:, hidden:]
        cand = np.tanh(x[:, 2 * hidden :] + (reset * state) @ p[f"{d}_cand"])
        if keep:
            saved.append((t, state, update, reset, cand))
        state = state + update * (cand - state)
        states[t] = state
    return states, saved


def label(p: Params, ids: np.ndarray, keep: bool = False):
    """Probabilities (length, words, languages) of equally long words, as byte values (words, length)."""
    fwd, saved_f = _run(p, "fwd", ids, keep)
    bwd, saved_b = _run(p, "bwd", ids, keep)
    logits = fwd @ p["fwd_out"] + bwd @ p["bwd_out"] + p["out_bias"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return (logits, fwd, bwd, saved_f, saved_b) if keep else logits


def gradients(p: Params, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
    """Weighted cross entropy per byte and its gradients, by backpropagation through time."""
    probs, fwd, bwd, saved_f, saved_b = label(p, ids, keep=True)
    length, n, _ = probs.shape
    scale = (weight / (weight.sum() * length)).astype(np.float32)
    loss = float(-(np.log(probs[:, np.arange(n), target] + 1e-12) * scale).sum())
    d_logits = probs.copy()
    d_logits[:, np.arange(n), target] -= 1
    d_logits *= scale[None, :, None]
    grads = {"out_bias": d_logits.sum(axis=(0, 1))}
    for d, states, saved in (("fwd", fwd, saved_f), ("bwd", bwd, saved_b)):
        gates_w, cand_w, out_w = p[f"{d}_gates"], p[f"{d}_cand"], p[f"{d}_out"]
        hidden = cand_w.shape[0]
        g_in, g_gates, g_cand = np.zeros_like(p[f"{d}_in"]), np.zeros_like(gates_w), np.zeros_like(cand_w)
        d_state = np.zeros((n, hidden), np.float32)
        for t, before, update, reset, cand in reversed(saved):
            d_state = d_state + d_logits[t] @ out_w.T
            d_cand = d_state * update * (1 - cand * cand)
            d_mixed = d_cand @ cand_w.T
            d_gates = np.concatenate((
                d_state * (cand - before) * update * (1 - update), d_mixed * before * reset * (1 - reset),
            ), axis=1)
            g_cand += (reset * before).T @ d_cand
            g_gates += before.T @ d_gates
            np.add.at(g_in, ids[:, t], np.concatenate((d_gates, d_cand), axis=1))
            d_state = d_state * (1 - update) + d_mixed * reset + d_gates @ gates_w.T
        grads |= {f"{d}_in": g_in, f"{d}_gates": g_gates, f"{d}_cand": g_cand}
        grads[f"{d}_out"] = np.einsum("tnh,tnl->hl", states, d_logits)
    return loss, grads


def train(words: list[bytes], labels: np.ndarray, weights: np.ndarray, languages: int, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 0) -> Params:
    """Adam over batches of equally long words."""
    p = init(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(min(len(w), SEGMENT), []).append(i)
    for epoch in range(epochs):
        batches = []
        for members in by_length.values():
            order = rng.permutation(members)
            batches += [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rate = RATE * (1 - epoch / epochs)
        for b in rng.permutation(len(batches)):
            at = batches[b]
            length = min(len(words[at[0]]), SEGMENT)
            ids = np.frombuffer(b"".join(words[i][:length] for i in at), np.uint8).reshape(len(at), length)
            _, grads = gradients(p, ids, labels[at], weights[at])
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


# -- fitting and applying on Spark -------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    params: Params
    triples: np.ndarray | None = None  # codes of the byte triples of the learned words
    least: float = 0.0  # share of learned triples below which a text is in none of the languages


def _triples(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of every byte of the runs with its neighbours, 0 beyond a run, in the runs' order."""
    lengths = ends - starts
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    here = data[at].astype(np.int64)
    before, after = np.roll(here, 1), np.roll(here, -1)
    before[np.cumsum(lengths) - lengths] = 0
    after[np.cumsum(lengths) - 1] = 0
    return before << 16 | here << 8 | after


def _word_triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Their codes, and the number of the word of each."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    return _triples(np.frombuffer(b"".join(words), np.uint8), ends - lengths, ends), np.repeat(np.arange(len(words)), lengths)


def _least(words: list[bytes], labels: np.ndarray, weights: np.ndarray) -> float:
    """``FOREIGN`` times the share of triples that words held out have in common with the others, in the
    language where it is least; each half is held out once."""
    codes, word = _word_triples(words)
    half, shares = word % 2 == 0, []
    known = np.where(half, np.isin(codes, codes[~half]), np.isin(codes, codes[half]))
    for k in np.unique(labels):
        own = labels[word] == k
        shares.append(np.average(known[own], weights=weights[word[own]]))
    return FOREIGN * float(min(shares))


def fit(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", hidden: int = HIDDEN) -> Model:
    """Fitted on a bounded sample: per language ``SAMPLE_DOCUMENTS`` documents of at most
    ``SAMPLE_TEXT_BYTES``, chosen by text hash, and of their words ``SAMPLE_WORDS``, chosen by word hash.  Rows with a
    null text or language teach nothing; without any, the model knows no language."""
    lang, text = F.col(f"`{lang_column}`").cast("string").alias("lang"), F.col(f"`{text_column}`").cast("string").alias("text")
    rows = labelled.select(lang, text).where("lang is not null and text is not null").where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)

    def some(df: DataFrame, most: int, *by: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(*by), *by))
        return df.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")

    # chosen among hashes; only the chosen texts travel, a bounded number, so their hashes may be broadcast
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    texts = hashed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("texts"))  # one row per language
    spread = F.pmod("hash", F.lit(1 << 30)) / (1 << 30)
    few = hashed.select("lang", "hash").join(F.broadcast(texts), "lang").where(spread < first_share(2 * SAMPLE_DOCUMENTS, F.col("texts")))
    chosen = some(few.select("lang", "hash").distinct(), SAMPLE_DOCUMENTS, "hash")
    spoken = hashed.join(F.broadcast(chosen), ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"]).select("lang", F.explode(F.split(F.lower("text"), r"[\x00-\x60\x7B-\x7F]+")).alias("word"))
    counts = spoken.where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    sample = some(counts, SAMPLE_WORDS, "word").collect()  # at most SAMPLE_WORDS per language
    sample = sorted((r["lang"], r["word"], r["n"]) for r in sample)
    languages = tuple(sorted({s[0] for s in sample}))
    if not languages:
        return Model((), {})
    labels = np.array([languages.index(s[0]) for s in sample])
    weights = np.sqrt(np.array([s[2] for s in sample], np.float64))
    # every language weighs the same, however its words are spread
    weights /= np.bincount(labels, weights)[labels]
    words = [s[1].encode() for s in sample]
    params = train(words, labels, weights * len(weights), len(languages), hidden)
    return Model(languages, params, np.unique(_word_triples(words)[0]), _least(words, labels, weights))


class _Labeller:
    """Sums of byte probabilities of runs, remembered by the run's hash."""

    def __init__(self, params: Params, languages: int) -> None:
        self.params, self.n = params, languages
        self.hasher = PartHashes()
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, languages), np.float32)

    def _label(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), self.n), np.float32)
        lengths = ends - starts
        # pieces of long runs, then batches of equal length
        count = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(starts)), count)
        begin = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        size = np.minimum(ends[owner] - begin, SEGMENT)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            length = int(size[order[a]])
            for i in range(a, b, 8192):
                at = order[i : min(i + 8192, b)]
                ids = data[begin[at][:, None] + np.arange(length)]
                np.add.at(out, owner[at], label(self.params, ids).sum(axis=0))
        return out

    def document_sums(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the summed probabilities and the number of bytes behind them."""
        small, starts, ends, row = letter_runs(data, at)
        rows = len(at) - 1
        if not len(starts):
            return np.zeros((rows, self.n)), np.zeros(rows)
        hashes = self.hasher.of(self.hasher.sums(small), starts, ends)
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, different)
        known = np.zeros(len(different), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == different
        values = np.empty((len(different), self.n), np.float32)
        values[known] = self.values[place[known]]
        new = ~known
        values[new] = self._label(small, starts[first[new]], ends[first[new]])
        if len(self.keys) + int(new.sum()) > MEMORY:
            self.keys, self.values = different, values
        else:
            self.keys = np.insert(self.keys, place[new], different[new])
            self.values = np.insert(self.values, place[new], values[new], axis=0)
        sums = np.stack([np.bincount(row, values[which, k], rows) for k in range(self.n)], axis=1)
        return sums, np.bincount(row, ends - starts, rows)


def _familiar(table: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row the share of its letters' triples that are learned; 0 without letters."""
    small, starts, ends, row = letter_runs(data, at)
    rows = len(at) - 1
    if not len(starts):
        return np.zeros(rows)
    hits = np.bincount(np.repeat(row, ends - starts), table[_triples(small, starts, ends)], rows)
    return hits / np.maximum(np.bincount(row, ends - starts, rows), 1)


def predict(
    documents: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text", with_text: bool = False,
    reject: bool = False,
) -> DataFrame:
    """``document`` (a struct of the carried columns), ``lang_pred`` and ``score``, the mean probability of that
    language over the text's letters; ``text`` if asked for.

    ``und`` with score 0 for a null text, one without letters, or a model without languages.  Equal
    probabilities go to the first language in alphabetical order.  The whole text counts, however long.  With
    ``reject`` also a text with too few learned byte triples is ``und`` with score 0, however many languages there are.
    """
    rows = documents.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("document"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )
    schema = rows.select("document", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), *["text"][: with_text]).schema
    languages = list(model.languages)
    params = documents.sparkSession.sparkContext.broadcast(model.params)
    triples, least = model.triples if reject else None, model.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(params.value, max(len(languages), 1)) if languages else None
        if triples is not None:
            table = np.zeros(1 << 24, bool)
            table[triples] = True
        for batch in batches:
            for piece, data, at in pieces(batch, "text"):
                names, scores = [UNKNOWN] * piece.num_rows, np.zeros(piece.num_rows)
                if labeller:
                    sums, n = labeller.document_sums(data, at)
                    plain = np.concatenate(([0], np.cumsum(IS_LETTER[data] & (data < 0x80))))
                    sure = plain[at[1:]] > plain[at[:-1]]
                    best = sums.argmax(axis=1)
                    if triples is not None:
                        n[_familiar(table, data, at) < least] = 0
                    for r in np.flatnonzero(n > 0).tolist():
                        # characters beyond ASCII may be no letters
                        if sure[r] or has_letter(piece.column("text")[r].as_py()):
                            names[r], scores[r] = languages[best[r]], min(1.0, float(sums[r, best[r]] / n[r]))
                columns = [piece.column("document"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                columns += [piece.column("text")][: with_text]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def held_out(id_column: Column, parts: int = 4, part: int = 2) -> Column:
    """Rows that teach nothing: the checksum of the id as text, modulo ``parts``, is ``part``; a null id is
    not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % parts == part, F.lit(False))
