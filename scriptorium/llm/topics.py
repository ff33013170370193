"""Topics of documents: spherical k-means on hashed words, fitted to all documents, named for every document.

A text is a vector of BUCKETS numbers, the tempered counts of its hashed words by how rare they are among all documents, less the mean of its language's vectors, so that a topic isn't just a
language; its topic is the centre of least angle. Centres begin as fixed random directions: no document is picked for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Workspace, column, give_back
from scriptorium.llm.shingles import word_hashes

#: Topics, buckets of hashed words, seed of the directions that centres begin with.
TOPICS, BUCKETS, SEED = 8, 1024, 3
#: Rounds over all documents at most, and the move of a centre at which they end.
FULL_ROUNDS, STILL = 20, 1e-3
#: Sums are of whole numbers of this unit, so that they don't depend on how rows are dealt.
UNIT = float(1 << 30)
#: A vector nearer than this to its language's mean has no direction.
LEAST = 1e-3
#: Texts that are made dense at once: 1 MB.
ROWS = 128
NONE = "none"


class Sparse:
    """Vectors of a batch's texts that have a word: ``at`` and ``n`` are the buckets and counts of all, ``first`` where each begins."""

    def __init__(self, at: list[bytes], n: list[bytes]):
        self.at = np.frombuffer(b"".join(at), np.int16).astype(np.int64)
        self.n = np.frombuffer(b"".join(n), np.int32)
        self.sizes = np.array([len(x) // 2 for x in at], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first)

    def unit(self, rare: np.ndarray) -> np.ndarray:
        x = np.sqrt(self.n) * rare[self.at]
        return x / np.repeat(np.maximum(np.sqrt(self.sums(x * x)), 1e-30), self.sizes)


class Topics:
    """``means`` by language, ``rare`` by bucket, ``centres`` a row for each topic."""

    def __init__(self, rare: np.ndarray, means: dict[str, np.ndarray], centres: np.ndarray):
        self.rare, self.means, self.centres = rare, means, centres
        # the angle with a centre is that of the raw vector, less that of the language's mean with the centre
        self.shift = {k: self.centres @ m for k, m in means.items()}

    def nearest(self, x: Sparse, unit: np.ndarray, langs: list[str]) -> np.ndarray:
        none = np.zeros(len(self.centres))
        shift = np.array([self.shift.get(lang, none) for lang in langs])
        return (np.array([x.sums(c[x.at] * unit) for c in self.centres]).T - shift).argmax(1)

    def names(self, at: list[bytes], n: list[bytes], langs: list[str]) -> list[str]:
        """The topic of each text, given by its buckets and counts."""
        out, some = [NONE] * len(at), [i for i, b in enumerate(at) if b]
        if some and len(self.centres):
            x = Sparse([at[i] for i in some], [n[i] for i in some])
            for i, c in zip(some, self.nearest(x, x.unit(self.rare), [langs[i] for i in some]).tolist(), strict=True):
                out[i] = f"t{c}"
        return out

    def __call__(self, words: np.ndarray, lang: str) -> str:
        at, n = buckets(words)
        return self.names([at], [n], [lang])[0]


def buckets(words: np.ndarray) -> tuple[bytes, bytes]:
    """The buckets of a text's hashed words (16 bits each) and how often each is met (32 bits)."""
    counts = np.bincount((words % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int16).tobytes(), counts[at].astype(np.int32).tobytes()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [buckets(word_hashes(t or b"")) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["language", "at", "n"])
    give_back()


def _total(vectors: DataFrame, of: Callable[[Sparse, list[str]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """For each name the sum over all batches of the whole numbers that ``of`` makes of one: BUCKETS + 1 a name. A task sends its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            at = batch.column(1).to_pylist()
            some = [i for i, b in enumerate(at) if b]
            if not some:
                continue
            langs, n = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for name, x in of(Sparse([at[i] for i in some], [n[i] for i in some]), [langs[i] for i in some]).items():
                found[name] = found.get(name, 0) + x.astype(np.int64)
        for name, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["name", "at", "sum"])
        give_back()

    out: dict[str, np.ndarray] = {}
    for name, at, n in vectors.mapInArrow(run, "name string, at int, sum bigint").groupBy("name", "at").agg(F.sum("sum")).toArrow().to_pandas().itertuples(index=False):
        out.setdefault(name, np.zeros(BUCKETS + 1, np.int64))[at] = n
    return dict(sorted(out.items()))


def _codes(langs: list[str]) -> tuple[list[str], np.ndarray]:
    names = sorted(set(langs))
    at = {k: i for i, k in enumerate(names)}
    return names, np.array([at[k] for k in langs], np.int64)


def _by(groups: np.ndarray, k: int, x: Sparse, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each of ``k`` groups of texts the sums of ``weight`` by bucket, and of ``own`` (a number a text) at BUCKETS."""
    out = np.bincount(np.repeat(groups * (BUCKETS + 1), x.sizes) + x.at, weight, k * (BUCKETS + 1)).reshape(k, -1)
    out[:, BUCKETS] = np.bincount(groups, own, k)
    return out


def _directions(rare: np.ndarray, means: dict[str, np.ndarray]):
    """What stays the same in all rounds, for texts with a word: the language's place in ``means``, one over the distance of its mean, the buckets, and the vector times that."""
    place, mean = {lang: i for i, lang in enumerate(means)}, np.array([*means.values()])
    square = (mean * mean).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.greater(pa.compute.binary_length(batch.column(1)), 0))
            if not len(batch):
                continue
            at = batch.column(1).to_pylist()
            x, code = Sparse(at, batch.column(2).to_pylist()), np.array([place[lang] for lang in batch.column(0).to_pylist()], np.int64)
            unit = x.unit(rare)
            apart = np.sqrt(np.maximum(0.0, x.sums(unit * unit) + square[code] - 2 * x.sums(unit * mean[np.repeat(code, x.sizes), x.at])))
            over = np.divide(1.0, apart, out=np.zeros_like(apart), where=apart > LEAST)
            own = (unit * np.repeat(over, x.sizes)).astype(np.float32).tobytes()
            parts = [own[4 * i : 4 * (i + size)] for i, size in zip(x.first.tolist(), x.sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(over), pa.array(at, pa.binary()), pa.array(parts, pa.binary())], names=["language", "over", "at", "x"])
        give_back()

    return run


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binary values without nulls, and where each value's begin and end; nothing is copied."""
    width = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // width
    return np.frombuffer(column.buffers()[2], kind, int(ends[-1])), ends


def _sums(directions: DataFrame, centres: np.ndarray, means: np.ndarray) -> np.ndarray:
    """For each centre the sum of the directions of its texts from their languages' means."""
    k, shift = len(centres), means @ centres.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((k, BUCKETS), np.int64), np.zeros((k, len(means)), np.int64)
        dense = np.zeros((ROWS, BUCKETS))
        for batch in batches:
            code, over = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            (at, ends), (x, _) = _joined(batch.column(2), np.int16), _joined(batch.column(3), np.float32)
            for i in range(0, len(code), ROWS):
                own = slice(ends[i], ends[min(i + ROWS, len(code))])
                rows, langs, o = np.arange(min(ROWS, len(code) - i)), code[i : i + ROWS], over[i : i + ROWS] * UNIT
                dense[:] = 0
                dense[np.repeat(rows, np.diff(ends[i : i + len(rows) + 1])), at[own]] = np.rint(x[own] * UNIT)
                near = ((dense @ centres.T)[: len(rows)] - o[:, None] * shift[langs]).argmax(1)
                pick = np.zeros((k, ROWS))
                pick[near, rows] = 1
                total += (pick @ dense).astype(np.int64)  # whole numbers below 2**53: exact in any order
                np.add.at(weight, (near, langs), np.rint(o).astype(np.int64))
        both = np.concatenate([total, weight], 1)
        some = np.flatnonzero(both.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c[some]) for c in both)], names=["at", *(f"s{i}" for i in range(k))])
        give_back()

    names = [f"s{i}" for i in range(k)]
    found = directions.mapInArrow(run, f"at int, {', '.join(f'{c} bigint' for c in names)}").groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out, at = np.zeros((k, BUCKETS + len(means))), found.column("at").to_numpy()
    for i, c in enumerate(names):
        out[i, at] = found.column(c).to_numpy()
    return (out[:, :BUCKETS] - out[:, BUCKETS:] @ means) / UNIT


def fit_vectors(vectors: DataFrame, k: int = TOPICS) -> Topics:
    """Topics of a written table (language, at, n) of the buckets of all texts. Rarity, languages' means and centres are those of all texts with a word; no such text: no topics."""

    def seen_in(x: Sparse, langs: list[str]) -> dict[str, np.ndarray]:
        return {"": np.r_[np.bincount(x.at, minlength=BUCKETS), len(langs)]}

    seen = _total(vectors, seen_in).get("", np.zeros(BUCKETS + 1, np.int64))
    n, seen = int(seen[-1]), seen[:-1]
    rare = np.where(seen > 0, np.log((1 + n) / (1 + np.maximum(seen, 0))) + 1e-3, 0.0)

    def by_language(x: Sparse, langs: list[str]) -> dict[str, np.ndarray]:
        names, code = _codes(langs)
        return dict(zip(names, _by(code, len(names), x, np.rint(x.unit(rare) * UNIT), np.ones(len(langs))), strict=True))

    means = {lang: x[:-1] / UNIT / x[-1] for lang, x in _total(vectors, by_language).items()}
    centres = np.random.default_rng(SEED).standard_normal((k if n else 0, BUCKETS))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    if n:
        ws = Workspace(vectors.sparkSession, "directions")
        directions = ws.keep(vectors.mapInArrow(_directions(rare, means), "language int, over double, at binary, x binary"), "directions")
        for _ in range(FULL_ROUNDS):
            size = np.linalg.norm(sums := _sums(directions, centres, np.array([*means.values()])), axis=1, keepdims=True)
            after = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
            moved, centres = float(np.linalg.norm(after - centres, axis=1).max()), after
            if moved < STILL:
                break
        ws.drop("directions")
    give_back()
    return Topics(rare, means, centres)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int | None = None, k: int = TOPICS) -> Topics:
    """Topics of all of ``docs``. ``id_col`` and ``sample`` have no effect: they stand for callers of a time when centres began with a sample."""
    ws = Workspace(docs.sparkSession, "topics")
    read = docs.select(column(docs, text_col).cast("string").alias("text"), F.coalesce(column(docs, lang_col).cast("string"), F.lit("")).alias("language"))
    found = fit_vectors(ws.keep(read.mapInArrow(_read, "language string, at binary, n binary"), "vectors"), k)
    ws.drop("vectors")
    return found
