"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

A text is a run of bytes: UTF-8 with A-Z in lower case, all other ASCII signs, digits and blanks folded into single spaces. The network reads it
in windows that overlap by CONTEXT bytes on either side, run on across words and are cut between characters. From both sides it gives every byte position a
distribution over languages; a document's distribution is the mean over all its positions, each counted in one window.
Training is backpropagation through time on windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import Workspace, column, fresh, give_back, shrink_heaps

#: Training takes at most so many documents a language, and so many in all (at least one a language); of those, whole texts.
TRAIN_DOCS, TRAIN_ALL = 250, 50_000
HIDDEN, STEPS, BATCH, RATE = 12, 600, 192, 0.02
#: Bytes of a training window.
TRAIN_WINDOW = 64
#: Bytes of a window that count (at most), and those read before and after them.
CORE, CONTEXT = 160, 16
#: Windows read at once; fewer where there are many languages, so that no more than CELLS numbers are held.
WINDOWS, CELLS = 2048, 1 << 22
UNDETERMINED = "und"
#: The pipeline rejects documents whose best language has less. A decision, not a bound on work: with the languages of a
#: web crawl, a text that no language claims for itself.
LEAST_SCORE = 0.3

_SPACE = 32
_fold = np.full(256, _SPACE, np.uint8)
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)
_fold[128:] = np.arange(128, 256)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Parameters by name. Forward and backward readers are alike: ``x`` (gates of each byte, a column each), ``u`` (state to gates), ``c`` (bias of the candidate's state
    part), ``o`` (state to languages). Arrays hold a feature a row and a window a column."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.p = {"bias": np.zeros((len(langs), 1), np.float32)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.p[f"u{d}"] = (rng.normal(0, 1, (3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros((hidden, 1), np.float32)
            self.p[f"o{d}"] = (rng.normal(0, 1, (len(langs), hidden)) / np.sqrt(2 * hidden)).astype(np.float32)

    def _read(self, d: str, tokens: np.ndarray, logits: np.ndarray, ends: np.ndarray | None, trace: list | None = None) -> None:
        """Read (time, window) bytes in direction d and add what the state after each says to ``logits`` (time, languages, window). From its end on, a window has no state."""
        n_h = self.hidden
        x, u, c, o = (self.p[f"{k}{d}"] for k in "xuco")
        h = np.zeros((n_h, tokens.shape[1]), x.dtype)
        least = len(tokens) if ends is None else int(ends.min())
        for t in range(len(tokens)) if d == "f" else range(len(tokens) - 1, -1, -1):
            gates, back = np.take(x, tokens[t], axis=1, mode="clip"), u @ h
            zr = gates[: 2 * n_h]
            zr += back[: 2 * n_h]
            z, r = _sigmoid(zr)[:n_h], zr[n_h:]
            s = back[2 * n_h :]
            s += c
            n = r * s
            n += gates[2 * n_h :]
            np.tanh(n, out=n)
            if trace is not None:
                trace.append((t, h, z, r, s, n))
            h = h - n
            h *= z
            h += n
            if t >= least:
                h[:, t >= ends] = 0
            logits[t] += o @ h

    def positions(self, tokens: np.ndarray, ends: np.ndarray | None = None, traces: dict[str, list] | None = None) -> np.ndarray:
        """Distributions over languages (time, languages, window); windows end at the last byte unless ``ends`` says otherwise."""
        logits = np.zeros((len(tokens), len(self.langs), tokens.shape[1]), self.p["bias"].dtype)
        logits += self.p["bias"]
        for d in "fb":
            self._read(d, tokens, logits, ends, traces[d] if traces else None)
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradients(self, tokens: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over positions, and its gradients by backpropagation through time."""
        n_h, g, traces = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}, {"f": [], "b": []}
        err = self.positions(tokens, traces=traces)
        which = np.arange(len(labels))
        loss = float(-np.log(err[:, labels, which] + 1e-9).mean())
        err[:, labels, which] -= 1
        err /= tokens.size
        g["bias"] = err.sum((0, 2))[:, None]
        for d in "fb":
            u, o = self.p[f"u{d}"], self.p[f"o{d}"]
            dh, into = np.zeros((n_h, len(labels)), o.dtype), np.empty((len(tokens), 3 * n_h, len(labels)), o.dtype)
            for t, h, z, r, s, n in reversed(traces[d]):
                g[f"o{d}"] += err[t] @ (n + z * (h - n)).T
                dh = dh + o.T @ err[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                ds = dn * r
                dr = dn * s * r * (1 - r)
                into[t] = np.concatenate([dz, dr, dn])
                inner = np.concatenate([dz, dr, ds])
                g[f"u{d}"] += inner @ h.T
                g[f"c{d}"] += ds.sum(1, keepdims=True)
                dh = dh * z + u.T @ inner
            read = tokens.reshape(-1)
            for i in range(3 * n_h):
                g[f"x{d}"][i] = np.bincount(read, into[:, i].reshape(-1), 256)
        return loss, g

    def train(self, texts: list[list[np.ndarray]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, width: int = TRAIN_WINDOW, seed: int = 11) -> list[float]:
        """Adam on windows of ``texts``, the folded texts of each language, every language as often; the losses.

        A third of the windows begin anywhere, a third up to CONTEXT bytes before a text, and a third as well but for that the text is cut short within the window.
        """
        rng = np.random.default_rng(seed)
        blank = np.full(width + CONTEXT, _SPACE, np.uint8)
        long = [np.concatenate([blank, *(y for x in own for y in (x, blank))]) for own in texts]
        begin = [np.cumsum([len(blank), *(len(x) + len(blank) for x in own[:-1])]) for own in texts]
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses = []
        for i in range(1, steps + 1):
            labels, way = (np.arange(batch) + i * batch) % len(texts), rng.integers(0, 3, batch)
            some, back, size = rng.random(batch), rng.integers(0, CONTEXT + 1, batch), rng.integers(3, width // 2, batch)
            windows = np.full((batch, width), _SPACE, np.uint8)
            for j, k in enumerate(labels):
                at = int(some[j] * (len(long[k]) - width)) if way[j] == 0 else begin[k][int(some[j] * len(begin[k]))] - back[j]
                n = width if way[j] < 2 else back[j] + size[j]
                windows[j, :n] = long[k][at : at + width][:n]
            loss, grads = self.gradients(np.ascontiguousarray(windows.T), labels)
            losses.append(loss)
            now = rate * min(1, 10 * (1 - i / (steps + 1)) ** 2 / 2 + 0.02)
            for k, v in grads.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= (now * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return losses


def folded(data: bytes) -> np.ndarray:
    """What the network reads of a text; empty if it has no letter (Unicode's categories L*)."""
    x = _fold[np.frombuffer(data, np.uint8)]
    ascii_letter = (x >= 97) & (x < 123)
    if not ascii_letter.any() and not any(map(str.isalpha, data.decode("utf-8", "replace"))):
        return x[:0]
    keep = x != _SPACE
    keep[1:] |= x[:-1] != _SPACE
    return x[keep]


def window_sums(net: Network, texts: list[np.ndarray], core: int = CORE, context: int = CONTEXT) -> np.ndarray:
    """For each folded text the sum of its positions' distributions, then their number."""
    pad = np.full(context, _SPACE, np.uint8)
    joined = np.concatenate([pad, *(x for t in texts for x in (t, pad)), np.full(core + 2 * context, _SPACE, np.uint8)])
    starts, sizes, owner, at = [], [], [], context
    for i, t in enumerate(texts):
        k = -(-len(t) // core)
        if k:
            cut = at + np.arange(k + 1) * len(t) // k  # windows of about the same size
            for _ in range(3):  # between characters: not before a byte that goes on with one
                cut[1:-1] += (joined[cut[1:-1]] & 0xC0) == 0x80
            starts.append(cut[:-1])
            sizes.append(np.diff(cut))
            owner.append(np.full(k, i))
        at += len(t) + context
    out = np.zeros((len(texts), len(net.langs) + 1))
    if not starts:
        return out
    start, size, own = np.concatenate(starts), np.concatenate(sizes), np.concatenate(owner)
    order = np.argsort(size, kind="stable")
    many = max(1, min(WINDOWS, CELLS // ((core + 2 * context) * len(net.langs))))
    for first in range(0, len(order), many):
        part = order[first : first + many]
        width = int(size[part].max()) + 2 * context
        column = np.arange(width)[:, None]
        tokens = joined[np.minimum(start[part] - context + column, len(joined) - 1)]
        counts = (column >= context) & (column < context + size[part])
        prob = net.positions(tokens, size[part] + 2 * context)  # so that a window's reading doesn't depend on what else is read
        np.add.at(out, own[part], np.concatenate([np.einsum("tlw,tw->wl", prob, counts.astype(prob.dtype), dtype=np.float64, casting="same_kind"), counts.sum(0)[:, None]], 1))
    return out


def predict(net: Network, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """The best language and its share of each text; und and 0 for a text without a letter, or if nothing was learnt."""
    read = [folded(t or b"") for t in texts]
    if not net.langs:
        return [(UNDETERMINED, 0.0)] * len(texts)
    out = []
    for s in window_sums(net, read):
        best = int(s[:-1].argmax())
        out.append((net.langs[best], round(float(min(1.0, s[best] / s[-1])), 6)) if s[-1] else (UNDETERMINED, 0.0))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_all: int = TRAIN_ALL, steps: int = STEPS) -> Network:
    """Train on whole texts of at most ``train_docs`` documents of each language, those of least hash of the identifier; on fewer, one at least, where the languages are so many that
    that would be more than ``train_all``.

    Rows whose crc32(identifier as text) mod 3 is 1, or that have no identifier, text or language, aren't learnt from. A language none of
    whose texts has a letter isn't learnt.
    """
    rows = docs.select(column(docs, id_col).cast("string").alias("id"), column(docs, text_col).cast("string").alias("text"), column(docs, lang_col).cast("string").alias("lang"))
    rows = rows.where("id is not null and text is not null and lang is not null and crc32(id) % 3 <> 1")
    counts = rows.groupBy("lang").count().toPandas()  # a row for each language
    if not len(counts):
        return Network([])
    each = max(1, min(train_docs, train_all // len(counts)))
    # a share of each language that holds more than enough, then exactly so many
    counts["share"] = np.minimum(1.0, 2 * (each + 10) / counts["count"]) * (1 << 30)
    shares = docs.sparkSession.createDataFrame([*zip(counts["lang"], counts["share"].tolist(), strict=True)], "lang string, share double")
    some = rows.withColumn("h", F.xxhash64("id")).join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share"))
    some = some.select("id", "lang", "h", "text").withColumn("k", F.expr("row_number() over (partition by lang order by h, id, text)")).where(F.col("k") <= each)
    found: dict[str, list[np.ndarray]] = {}
    for r in sorted(some.collect(), key=lambda r: (r["lang"], r["k"])):
        x = folded(r["text"].encode("utf-8", "surrogatepass"))
        if len(x):
            found.setdefault(r["lang"], []).append(x)
    net = Network(sorted(found))
    if found:
        net.train([found[k] for k in net.langs], steps)
    return net


def _slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some ``most`` bytes of text together, or one row."""
    first, held = 0, 0
    for i, size in enumerate(pa.compute.binary_length(column).to_pylist()):
        held += size or 0
        if held >= most:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(column):
        yield first, len(column)


def identify(spark: SparkSession, docs: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, unless given) and two more, lang_pred and score, whose names are lengthened by ``_`` where they are taken.

    Every row and whole text is read. A text that is null or has no letter (numerals, signs, blanks, nothing) is ``und`` with score 0, as is every text if nothing was learnt. A tie goes to the
    language first in alphabetical order. Repeated rows get the same answer. No rows: no rows.
    """
    Workspace(spark, "langid")
    kept = docs.columns if keep is None else keep
    pred = fresh(kept, "lang_pred")
    score = fresh([*kept, pred], "score")
    held = spark.sparkContext.broadcast(net)
    # plain names on the way through, as mapInArrow takes no others
    given = docs.select(column(docs, text_col).cast("string").alias("read"), *[column(docs, c).alias(f"c{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*given.schema.fields[1:], T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for a, b in _slices(texts):
                said = predict(held.value, texts[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=[f.name for f in schema.fields])
        give_back()

    return given.mapInArrow(run, schema).toDF(*kept, pred, score)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(spark, docs, fit(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognised language (no letter, or a best score under LEAST_SCORE) go; the others keep all columns."""
    shrink_heaps(spark)
    found = identify(spark, docs, fit(docs))
    pred, score = found.columns[-2:]
    return found.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)
