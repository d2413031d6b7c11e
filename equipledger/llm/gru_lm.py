"""Gated recurrent language model: truncated backpropagation in numpy, class-factored softmax, state carried across
windows, complete-document log-likelihood.

Word counts of the whole corpus give the short list (frequent words, with a learned softmax inside their class) and
the share of every other word inside its tail class (add-one: a word never seen is one more type of it).

Recurrent weights: every training document is dealt by a hash of its id and text to one of many shards and one of ``ROUNDS``
slices. In each round every shard goes on from the common weights and Adam moments through its slice, and the results are
averaged by tokens. A shard holds about ``SHARD_TOKENS`` tokens at any size of the corpus, so the number of updates between averages
does not depend on files, partitions or machines; more text means more shards. Counts of words outside a bounded head are joined
to the (document, word) pairs that need them, so nothing unbounded is broadcast.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipledger.llm.common import doc_bucket, head_of, saved, table

END = " "                     # the end token; no word holds a blank
HEAD_WORDS = 1 << 17          # words whose counts every task gets (a bounded table)
HEAD_BYTES = 64               # longer words are never in the head
WORDS_IN_CLASS, CLASSES, TAILS = 32, 32, 32
SHORT = WORDS_IN_CLASS * CLASSES
HIDDEN = 16
ROUNDS, WINDOW, RATE = 4, 32, 0.02
SHARD_TOKENS = 1_500_000      # of a shard, all rounds together
UPDATES = 64                  # of a shard in a round, where it has streams enough
STREAMS, MOST_STREAMS = 16, 512
CHUNK_WORDS = 100_000         # of one window while scoring
SUMMING = 8                   # tasks that sum up the shards' weights


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def _tail_class(word: str = "word"):
    w = F.col(word).cast("binary")
    return (F.crc32(F.substring(w, F.greatest(F.octet_length(word) - 1, F.lit(1)), F.lit(2))) % TAILS).cast("int")


def count_words(train: DataFrame) -> DataFrame:
    """``(word, n)`` over all training tokens, the end token included, counted per batch before the shuffle."""
    def run(batches):
        from collections import Counter
        for b in batches:
            total: Counter = Counter()
            for t in b.column(0):
                total.update(tokens(t.as_py()))
            words = [w.decode("utf-8", "replace") for w in total]
            yield pa.RecordBatch.from_arrays([pa.array([*words, END], pa.string()), pa.array([*total.values(), b.num_rows], pa.int64())],
                                             names=["word", "n"])

    return train.select("text").mapInArrow(run, "word string, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def _shift(w: np.ndarray, b: np.ndarray) -> tuple[np.float32, bool]:
    """States lie within -1 and 1, so a row's greatest logit is between two bounds that hold for all rows: shifted by the upper
    one no row overflows, and none vanishes while the bounds are near."""
    reach = np.abs(w).sum(axis=0)
    top = (b + reach).max()
    return top, bool(top - (b - reach).max() < 80)


def _loss_gradient(h1: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray, share) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``share`` times the log loss of a softmax at the places ``at``: by weights and bias (last row), and by the
    states. ``h1``: states and a column of ones."""
    top, near = _shift(w, b)
    p = h1 @ np.concatenate((w, (b - top)[None]))
    if not near:
        p -= p.max(axis=1, keepdims=True)
    np.exp(p, p)
    p *= share / p.sum(axis=1, keepdims=True)
    p[np.arange(len(p)), at] -= share
    return h1.T @ p, p @ w.T


def _picked(h: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax of ``h @ w + b`` at the places ``at``."""
    top, near = _shift(w, b)
    logit = h @ w
    logit += b - top
    if not near:
        logit -= logit.max(axis=1, keepdims=True)
    own = logit[np.arange(len(h)), at]
    np.exp(logit, logit)
    return own - np.log(logit.sum(axis=1))


class Gru:
    """Input rows (short list words, then tail classes) hold their three gate inputs; classes are the short list's
    ``CLASSES``, then ``TAILS``."""

    NAMES = ["x", "u", "un", "wc", "bc", "wo", "bo"]

    def __init__(self, short_counts: np.ndarray, tail_counts: np.ndarray):
        rng, h = np.random.default_rng(3), HIDDEN
        self.x = rng.normal(0, 0.3, (SHORT + TAILS, 3 * h)).astype(np.float32)
        self.u = rng.normal(0, 0.2, (h, 2 * h)).astype(np.float32)
        self.un = rng.normal(0, 0.2, (h, h)).astype(np.float32)
        self.wc = rng.normal(0, 0.1, (h, CLASSES + TAILS)).astype(np.float32)
        self.wo = rng.normal(0, 0.1, (CLASSES, h, WORDS_IN_CLASS)).astype(np.float32)
        c = short_counts.reshape(CLASSES, WORDS_IN_CLASS)
        self.bc = np.log(np.concatenate((c.sum(axis=1), tail_counts)) + 0.5).astype(np.float32)
        self.bc -= self.bc.max()
        self.bo = np.log(c + 0.01).astype(np.float32)
        self.bo -= self.bo.max(axis=1, keepdims=True)

    def step(self, x: np.ndarray, h: np.ndarray):
        k = HIDDEN
        zr = h @ self.u
        zr += x[:, :2 * k]
        np.negative(zr, zr)
        np.exp(zr, zr)
        zr += 1.0
        np.reciprocal(zr, zr)
        z, r = zr[:, :k], zr[:, k:]
        n = (r * h) @ self.un
        n += x[:, 2 * k:]
        np.tanh(n, n)
        new = n - h
        new *= z
        new += h
        return new, z, r, n

    def log_prob(self, h: np.ndarray, cls: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P of a class and, for the short list, of the word in it (word: place in its class, else -1)."""
        order = np.argsort(cls.astype(np.int16), kind="stable")       # by class, so that each is one stretch
        h, cls, word = h[order], cls[order], word[order]
        own = _picked(h, self.wc, self.bc, cls).astype(np.float64)
        cut = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            a, b = cut[c], cut[c + 1]
            if a < b:
                own[a:b] += _picked(h[a:b], self.wo[c], self.bo[c], word[a:b])
        out = np.empty(len(own))
        out[order] = own
        return out / np.log(10)

    def begin(self) -> None:
        """Adam's moments, from nothing."""
        self.moments = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.NAMES}
        self.turn = 0.0

    def fit(self, text: np.ndarray, end: int) -> None:
        """Truncated backpropagation with Adam over ``text`` (input numbers of whole documents, each closed by ``end``), cut into
        equal streams that go through it side by side, ``WINDOW`` steps an update. The state goes on from window to window and
        starts anew after an end."""
        streams = min(MOST_STREAMS, max(STREAMS, len(text) // (WINDOW * UPDATES)))
        time = -(-len(text) // streams)
        ids = np.full(time * streams, -1, dtype=np.int64)
        ids[:len(text)] = text
        ids = ids.reshape(streams, time).T
        last = np.concatenate(([end], ids[-1, :-1]))            # what stands before each stream
        h, last = np.zeros((streams, HIDDEN), self.x.dtype), np.where(last < 0, end, last)
        for s in range(0, time, WINDOW):
            h, last, grad = self._window(ids[s:s + WINDOW], h, last, end)
            self.turn += 1
            for n, g in grad.items():
                norm = float(np.sqrt((g * g).sum()))
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m, v = self.moments[n]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                getattr(self, n)[...] -= RATE * (m / (1 - 0.9 ** self.turn)) / (np.sqrt(v / (1 - 0.99 ** self.turn)) + 1e-6)

    def _window(self, ids, h, last, end):
        """States, last inputs and gradients of the mean log loss over the targets ``ids`` (steps x streams, -1 where a stream
        is over)."""
        k, (steps, lanes) = HIDDEN, ids.shape
        prev = np.concatenate((last[None], ids[:-1]))
        prev = np.where(prev < 0, end, prev)
        x, keep = self.x[prev], (prev != end).astype(self.x.dtype)[:, :, None]
        h0s, zs, rs, ns, hs = (np.empty((steps, lanes, k), self.x.dtype) for _ in range(5))
        for t in range(steps):
            h0 = h * keep[t]
            h, zs[t], rs[t], ns[t] = self.step(x[t], h0)
            h0s[t], hs[t] = h0, h
        last = np.where(ids[-1] < 0, end, ids[-1])
        live = np.flatnonzero(ids.reshape(-1) >= 0)
        target = ids.reshape(-1)[live]
        grad = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        if not len(target):
            return h, last, grad
        share = np.float32(1.0 / len(target))
        cls = np.where(target < SHORT, target // WORDS_IN_CLASS, CLASSES + target - SHORT)
        order = np.argsort(cls.astype(np.int16), kind="stable")       # by class, so that each is one stretch
        live, target, cls = live[order], target[order], cls[order]
        flat = np.ones((len(live), k + 1), self.x.dtype)              # a state and the one of its bias
        flat[:, :k] = hs.reshape(-1, k)[live]
        both, back = _loss_gradient(flat, self.wc, self.bc, cls, share)
        grad["wc"], grad["bc"] = both[:k], both[k]
        cut = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            a, b = cut[c], cut[c + 1]
            if a < b:
                both, more = _loss_gradient(flat[a:b], self.wo[c], self.bo[c], target[a:b] % WORDS_IN_CLASS, share)
                grad["wo"][c], grad["bo"][c] = both[:k], both[k]
                back[a:b] += more
        outer = np.zeros((steps * lanes, k), self.x.dtype)
        outer[live] = back
        outer = outer.reshape(steps, lanes, k)
        gates = np.empty((steps, lanes, 3 * k), self.x.dtype)
        carry = np.zeros((lanes, k), self.x.dtype)
        for t in range(steps - 1, -1, -1):
            d, g, h0, z, r, n = outer[t] + carry, gates[t], h0s[t], zs[t], rs[t], ns[t]
            into = d * z
            g[:, 2 * k:] = into * (1 - n * n)
            g[:, :k] = into * (n - h0) * (1 - z)
            drh = g[:, 2 * k:] @ self.un.T
            g[:, k:2 * k] = drh * h0 * r * (1 - r)
            carry = (d - into + drh * r + g[:, :2 * k] @ self.u.T) * keep[t]
        gates = gates.reshape(-1, 3 * k)
        grad["u"] = h0s.reshape(-1, k).T @ gates[:, :2 * k]
        grad["un"] = (rs * h0s).reshape(-1, k).T @ gates[:, 2 * k:]
        prev = prev.reshape(-1)
        order = np.argsort(prev.astype(np.int16), kind="stable")      # input rows are fewer than 2 ** 15
        rows = prev[order]
        at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        grad["x"][rows[at]] = np.add.reduceat(gates[order], at, axis=0)
        return h, last, grad

    def state(self) -> np.ndarray:
        """Weights, moments and the number of updates as one row of numbers."""
        return np.concatenate([self.get(), *[m.reshape(-1) for n in self.NAMES for m in self.moments[n]], [self.turn]]).astype(np.float64)

    def set_state(self, flat: np.ndarray) -> None:
        self.begin()
        self.put(flat)
        at = sum(getattr(self, n).size for n in self.NAMES)
        for n in self.NAMES:
            for m in self.moments[n]:
                m[...] = flat[at:at + m.size].reshape(m.shape)
                at += m.size
        self.turn = float(flat[at])

    def get(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.NAMES])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            a = getattr(self, n)
            a[...] = flat[at:at + a.size].reshape(a.shape)
            at += a.size


class Vocabulary:
    """What every task gets: the head (word -> rank) with its counts, and tokens and types of the tail classes."""

    def __init__(self, head: list[tuple[str, int]], total: int, distinct: int, tails: np.ndarray, types: np.ndarray):
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        self.rank = {w.encode(): i for i, (w, _) in enumerate(head)}
        self.total, self.distinct, self.tails = total, distinct, tails
        self.space = tails + types + 1
        c = np.array([n for _, n in head], dtype=np.float64)
        self.short_counts = np.concatenate((c[:SHORT], np.zeros(max(0, SHORT - len(c)))))
        n = min(SHORT, len(head))
        self.row = np.arange(len(head))                       # input row
        self.row[n:] = [SHORT + tail_class(w.encode()) for w, _ in head[n:]]
        self.inside = np.zeros(len(head))                     # log10 of what a tail word has of its class
        self.inside[n:] = np.log10((c[n:] + 1) / self.space[self.row[n:] - SHORT])
        self.base = np.log10((c + 1) / (total + distinct + 1))

    @classmethod
    def of(cls, parts: dict) -> "Vocabulary":
        """From ``vars(vocabulary)``: what is broadcast is plain data, which workers without this package can read."""
        v = cls.__new__(cls)
        v.__dict__.update(parts)
        return v


def vocabulary(counts: DataFrame) -> Vocabulary | None:
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    if not sums["n"]:
        return None
    head = [(r["word"], r["n"]) for r in head_of(counts.where(F.octet_length("word") <= HEAD_BYTES), HEAD_WORDS).collect()]
    if END not in dict(head):
        head += [(r["word"], r["n"]) for r in counts.where(F.col("word") == END).collect()]
    tails, types = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.groupBy(_tail_class().alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():   # TAILS rows
        tails[r["k"]], types[r["k"]] = r["n"], r["v"]
    for w, n in sorted(head, key=lambda x: (-x[1], x[0]))[:SHORT]:
        tails[tail_class(w.encode())] -= n
        types[tail_class(w.encode())] -= 1
    return Vocabulary(head, sums["n"], sums["v"], tails, types)


class _Rows(dict):
    """Word -> input row; words outside the head by their tail class."""

    def __missing__(self, word: bytes) -> int:
        return SHORT + tail_class(word)


class _Ranks(dict):
    """Word -> rank in the head; others get numbers behind it, in the order of their coming."""

    def begin(self) -> dict[bytes, int]:
        self.fresh: dict[bytes, int] = {}
        return self.fresh

    def __missing__(self, word: bytes) -> int:
        return self.fresh.setdefault(word, len(self.fresh)) + len(self)


def _numbers(table_: dict, words: list[bytes], end: int) -> np.ndarray:
    out = np.empty(len(words) + 1, dtype=np.int64)
    out[:-1] = np.fromiter(map(table_.__getitem__, words), np.int64, len(words))
    out[-1] = end
    return out


def dealt(docs: DataFrame, v: Vocabulary, shared) -> DataFrame:
    """``(shard, slice, key, ids)`` of every row of ``docs``: its input numbers as two-byte numbers, the end last. The key is a
    hash of id and text, so copies of a text and repeated ids are spread."""
    shards = max(1, round(v.total / SHARD_TOKENS))

    def run(batches):
        v = Vocabulary.of(shared.value)
        rows, end = _Rows(zip(v.rank, v.row.tolist())), int(v.row[v.rank[END.encode()]])
        for b in batches:
            ids = [_numbers(rows, tokens(t.as_py()), end).astype("<i2").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    d = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "key long, ids binary")
    return d.select((F.pmod("key", F.lit(ROUNDS))).cast("int").alias("slice"),
                    (F.pmod(F.shiftright("key", 20), F.lit(shards))).cast("int").alias("shard"), "key", "ids")


def _sums(batches):
    """One row for all of a task: the sum of its rows (n, w), w numbers as bytes."""
    n, w = 0, None
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n, w = n + k, np.frombuffer(x) if w is None else w + np.frombuffer(x)
    if w is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["n", "w"])


def train(docs: DataFrame, v: Vocabulary, shared) -> Gru:
    """Recurrent weights from all of ``docs`` (doc_id, text), whatever their files and partitions. Without any document the start
    weights stand."""
    spark, gru, end = docs.sparkSession, Gru(v.short_counts, v.tails), int(v.row[v.rank[END.encode()]])
    gru.begin()
    coded = saved(dealt(docs, v, shared), "lm-coded")
    counts = v.short_counts, v.tails
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(gru.state())

        def run(batches):
            g, total, n, shard, held = Gru(*counts), None, 0, None, []

            def close():
                nonlocal total, n
                if held:
                    g.set_state(start.value)
                    text = np.concatenate(held)
                    g.fit(text, end)
                    total = g.state() * len(text) + (0 if total is None else total)
                    n += len(text)

            for b in batches:
                for at, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if at != shard:
                        close()
                        shard, held = at, []
                    held.append(np.frombuffer(ids, "<i2"))
            close()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])

        rows = coded.where(F.col("slice") == k).repartition("shard").sortWithinPartitions("shard", "key").select("shard", "ids")
        sums = rows.mapInArrow(run, "n long, w binary").repartition(SUMMING).mapInArrow(_sums, "n long, w binary").collect()
        if sums:          # at most SUMMING rows
            gru.set_state(sum(np.frombuffer(r["w"]) for r in sums) / sum(r["n"] for r in sums))
    return gru


def _score(texts: list[str | None], v: Vocabulary, g: Gru, known: _Ranks | None = None):
    """Arrays over the texts (tokens, head tokens, base and model log10 of all but the counts of words outside the head) and
    over the pairs of a text and such a word (number of the text, number of the word, how often), and those words."""
    n_head, end = len(v.rank), v.rank[END.encode()]
    known = _Ranks(v.rank) if known is None else known
    fresh = known.begin()
    ranks = [_numbers(known, tokens(t), end) for t in texts]
    new = list(fresh)
    row = np.concatenate((v.row, np.array([SHORT + tail_class(w) for w in new], dtype=np.int64)))
    inside = np.concatenate((v.inside, np.zeros(len(new))))
    base = np.concatenate((v.base, np.zeros(len(new))))
    score = np.zeros(len(texts))
    order = np.argsort([-len(r) for r in ranks], kind="stable")       # long ones first: those still running stand in front
    size = np.array([len(ranks[k]) for k in order], dtype=np.int64)
    flat = row[np.concatenate([ranks[k] for k in order])]
    starts = np.cumsum(size) - size
    h, last, total = np.zeros((len(order), HIDDEN), dtype=np.float32), np.full(len(order), row[end]), np.zeros(len(order))
    at = 0
    while len(size) and at < size[0]:               # windows; the state goes on from one to the next
        live = int(np.searchsorted(-size, -at, side="left"))
        steps = int(min(size[0] - at, max(1, CHUNK_WORDS // live), 256))
        when = at + np.arange(steps)
        there = when[:, None] < size[None, :live]
        ids = flat[np.minimum(starts[None, :live] + when[:, None], len(flat) - 1)]
        x = g.x[np.concatenate((last[None, :live], ids[:-1]))]
        hs = np.zeros((steps, live, HIDDEN), dtype=np.float32)
        for t, m in enumerate(there.sum(axis=1).tolist()):
            h = g.step(x[t, :m], h[:m])[0]
            hs[t, :m] = h
        last[:live] = ids[-1]
        target = ids[there]
        cls = np.where(target < SHORT, target // WORDS_IN_CLASS, CLASSES + target - SHORT)
        p = g.log_prob(hs[there], cls, target % WORDS_IN_CLASS)
        total[:live] += np.bincount(np.nonzero(there)[1], weights=p, minlength=live)
        at += steps
    score[order] = total
    every = np.concatenate(ranks)
    n = np.array([len(r) for r in ranks], dtype=np.int64)
    begins = np.cumsum(n) - n
    far = np.flatnonzero(every >= n_head)
    text = np.repeat(np.arange(len(ranks)), n)[far]
    pair, m = np.unique(text * max(1, len(new)) + every[far] - n_head, return_counts=True)
    of, word = np.divmod(pair, max(1, len(new)))
    return (n, n - np.bincount(text, minlength=len(ranks)), np.add.reduceat(base[every], begins),
            score + np.add.reduceat(inside[every], begins), of, word, m, new)


def log_likelihood(docs: DataFrame, train_on: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 P of the whole text,
    its end included). The model learns from ``train_on`` alone.

    Null and empty texts have the end token only. Repeated rows are scored each; without training text all
    classes are alike and n_known is 0; extra columns are ignored; an empty table gives no rows."""
    counts = saved(count_words(train_on), "lm-words")
    v = vocabulary(counts)
    if v is None:
        v = Vocabulary([(END, 0)], 0, 0, np.zeros(TAILS), np.zeros(TAILS))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vars(v))
    g = train(train_on, v, shared)
    weights = sc.broadcast(g.get())

    def run(batches):
        v = Vocabulary.of(shared.value)
        g = Gru(v.short_counts, v.tails)
        g.put(weights.value)
        known = _Ranks(v.rank)
        names = ["key", "doc_id", "n_tokens", "n_known", "base", "score", "word", "m"]
        for b in batches:
            if not b.num_rows:
                continue
            n, head, base, score, of, word, m, new = _score(b.column(2).to_pylist(), v, g, known)
            none = [pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(head), pa.array(base), pa.array(score), *none], names=names)
            if len(of):
                words = pa.array([w.decode("utf-8", "replace") for w in new], pa.string())
                none = [pa.nulls(len(of), k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), *none,
                                                  words.take(pa.array(word)), pa.array(m)], names=names)

    rows = saved(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "key long, doc_id long, n_tokens long, n_known long, base double, score double, word string, m long"), "lm-scores")
    whole = float(v.total + v.distinct + 1)
    space = F.array(*[F.lit(float(x)) for x in v.space])
    far = rows.where("word is not null").join(counts.select(F.col("word").alias("c_word"), F.col("n").alias("c")), F.col("word") == F.col("c_word"), "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    far = far.select("key", F.when(c > 0, F.col("m")).otherwise(0).alias("n_known"), (F.col("m") * F.log10((c + 1) / whole)).alias("base"),
                     (F.col("m") * F.log10((c + 1) / F.get(space, _tail_class()))).alias("score"))
    far = far.groupBy(F.col("key").alias("f_key")).agg(*[F.sum(x).alias(f"f_{x}") for x in ("n_known", "base", "score")])
    d = rows.where("word is null").join(far, F.col("key") == F.col("f_key"), "left")
    known = F.col("n_known") if v.total else F.lit(0)
    return d.select("doc_id", "n_tokens", (known + F.coalesce("f_n_known", F.lit(0))).cast("long").alias("n_known"),
                    F.lit(v.total).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("f_base", F.lit(0.0))).alias("base_score"),
                    (F.col("score") + F.coalesce("f_score", F.lit(0.0))).alias("score"))


def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = log_likelihood(docs, docs.where(doc_bucket(7) != 2))
    return d.select("doc_id", F.coalesce(doc_bucket(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
