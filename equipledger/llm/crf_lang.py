"""Language ID: a linear-chain conditional random field labels every word of code-switched text.

Emissions are sums of hashed weights of a word's affixes and character n-grams and of learned lexicons; transitions
are learned with them by gradient ascent on the exact likelihood (forward-backward). The model is fitted in one task
on a bounded sample of documents; every whole text is then labelled in the task that reads it.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from equipledger.llm.common import doc_bucket, table

DOCS_PER_LANG = 150       # training documents of a language (a documented bound; whole texts)
FEATURES = 1 << 15        # hashed n-gram and affix features
LEXICON = 500             # most frequent training words of a language
SEQUENCE = 64             # words of a training sequence, put together from spans of several documents
EPOCHS, BATCH, RATE, DECAY = 3, 32, 0.25, 1e-6
CHUNK_WORDS = 300_000     # words of texts of like length that are labelled together
WORD = re.compile(r"[^\W\d_]+")
MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; numerals such as ½ or ² are no letters."""
    found = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after the other, and where each word's begin: 2- and 3-grams of the word
    between edge marks (so 1- and 2-letter affixes too) and 3-letter affixes."""
    cp = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    first = np.flatnonzero(cp == 2)
    length = np.diff(np.append(first, len(cp)))                      # letters and two marks: 3 at least

    def spread(n, kind):
        h = np.full(len(cp) - n + 1, kind, dtype=np.uint64)
        for k in range(n):
            h = (h ^ cp[k:len(cp) - n + 1 + k]) * MULT
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(40)).astype(np.int64) % FEATURES
    two, three = spread(2, 2), spread(3, 3)
    four = spread(4, 4) if len(cp) >= 4 else np.zeros(1, np.int64)
    count = (length - 1) + (length - 2) + 2
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    out = np.empty(int(count.sum()), dtype=np.int64)

    def place(values, size, offset):
        at = np.repeat(first, size) + _ranges(size)
        out[np.repeat(start + offset, size) + _ranges(size)] = values[at]
    place(two, length - 1, 0)
    place(three, length - 2, length - 1)
    affix = start + 2 * length - 3
    long = length >= 4
    out[affix] = np.where(long, four[np.minimum(first, len(four) - 1)], 0)
    out[affix + 1] = np.where(long, (four[np.clip(first + length - 4, 0, len(four) - 1)] + 1) % FEATURES, 0)
    return out, start


def _ranges(size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)


class Crf:
    def __init__(self, langs: list[str], lexicon: dict[str, list[int]]):
        y = len(langs)
        self.langs, self.lexicon = langs, lexicon                     # word -> numbers of the languages that list it
        self.w = np.zeros((FEATURES, y), dtype=np.float32)
        self.lex = np.zeros((y, y), dtype=np.float32)
        self.trans, self.begin = np.zeros((y, y)), np.zeros(y)

    def listed(self, words: list[str]) -> np.ndarray:
        get = self.lexicon.get
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        hits = [(k, i) for k, w in enumerate(words) for i in get(w, ())]
        if hits:
            out[tuple(np.array(hits).T)] = 1.0
        return out

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, languages): the score of every label for each of the distinct words."""
        if not words:
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        f, start = features(words)
        return np.add.reduceat(self.w[f], start, axis=0) + self.listed(words) @ self.lex

    def marginals(self, emit: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """Forward-backward over texts laid side by side: emit (time, text, label), longest text first. Returns label
        probabilities of the same shape and, for training, the expected transitions summed over the texts."""
        p = np.exp(emit - emit.max(axis=2, keepdims=True))
        t, y = np.exp(self.trans - self.trans.max()).astype(p.dtype), p.shape[2]
        begin = np.exp(self.begin - self.begin.max()).astype(p.dtype)
        time = p.shape[0]
        live = np.searchsorted(-lengths, -np.arange(time), side="left")   # texts longer than the time
        a = np.zeros_like(p)
        a[0] = p[0] * begin
        a[0] /= a[0].sum(axis=1, keepdims=True)
        for i in range(1, time):
            n = live[i]
            x = (a[i - 1, :n] @ t) * p[i, :n]
            a[i, :n] = x / x.sum(axis=1, keepdims=True)
        expected = np.zeros((y, y))
        b = np.ones_like(p[0])
        for i in range(time - 2, -1, -1):
            n = live[i + 1]
            x = p[i + 1, :n] * b[:n]
            if pairs:
                joint = a[i, :n, :, None] * t[None] * x[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            x = x @ t.T
            b[:n] = x / x.sum(axis=1, keepdims=True)
            g = a[i, :n] * b[:n]
            a[i, :n] = g / g.sum(axis=1, keepdims=True)
        return a, expected

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, w=self.w, lex=self.lex, trans=self.trans, begin=self.begin, langs=np.array(self.langs, dtype=object),
                 words=np.array(list(self.lexicon), dtype=object), lists=np.array(list(self.lexicon.values()) + [[]], dtype=object))
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Crf:
        z = np.load(io.BytesIO(raw), allow_pickle=True)
        m = Crf(z["langs"].tolist(), dict(zip(z["words"].tolist(), z["lists"].tolist())))
        m.w, m.lex, m.trans, m.begin = z["w"], z["lex"], z["trans"], z["begin"]
        return m


def train(texts: list[str], langs: list[str]) -> Crf:
    """Fits on sequences of ``SEQUENCE`` words made of spans of 4 to 60 words from random documents, so that the
    transitions learn how code-switched text goes on and changes. Adagrad over minibatches; deterministic."""
    from collections import Counter

    names = sorted(set(langs))
    split = [words_of(t) for t in texts]
    ids = np.array([names.index(x) for x in langs])
    lexicon: dict[str, list[int]] = {}
    for i in range(len(names)):
        top = Counter(w for k, ws in enumerate(split) if ids[k] == i for w in ws)
        for w, _ in sorted(top.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(i)
    m = Crf(names, lexicon)
    number: dict[str, int] = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int64) for ws in split]
    usable = [k for k in range(len(split)) if len(split[k])]
    if not usable:
        return m
    f, start = features(list(number))
    stop = np.append(start[1:], len(f))
    listed = m.listed(list(number))
    rng = np.random.default_rng(1)
    by_lang = [[k for k in usable if ids[k] == i] for i in range(len(names))]
    by_lang = [x for x in by_lang if x]
    need = SEQUENCE * max(1, sum(len(c) for c in coded) // SEQUENCE)
    g_w, g_lex = np.full_like(m.w, 1e-3), np.full_like(m.lex, 1e-3)
    g_t, g_b = np.full_like(m.trans, 1e-3), np.full_like(m.begin, 1e-3)
    for _ in range(EPOCHS):
        stream, label, got = [], [], 0
        while got < need:
            group = by_lang[rng.integers(len(by_lang))]
            k = group[rng.integers(len(group))]
            at, size = rng.integers(len(coded[k])), rng.integers(4, 61)
            part = coded[k][at:at + size]
            stream.append(part)
            label.append(np.full(len(part), ids[k]))
            got += len(part)
        words = np.concatenate(stream)[:need].reshape(-1, SEQUENCE)
        truth = np.concatenate(label)[:need].reshape(-1, SEQUENCE)
        for s in range(0, len(words), BATCH):
            x, y = words[s:s + BATCH].T, truth[s:s + BATCH].T        # (time, text)
            uniq, inv = np.unique(x, return_inverse=True)
            size = stop[uniq] - start[uniq]
            feat = f[np.repeat(start[uniq], size) + _ranges(size)]
            edge = np.cumsum(size) - size
            e = (np.add.reduceat(m.w[feat], edge, axis=0) + listed[uniq] @ m.lex)[inv.reshape(x.shape)]
            prob, expected = m.marginals(e, np.full(x.shape[1], SEQUENCE), pairs=True)
            gold = np.eye(len(names), dtype=np.float32)[y]
            diff = (gold - prob).reshape(-1, len(names)) / x.shape[1]
            word = np.zeros((len(uniq), len(names)), dtype=np.float32)
            np.add.at(word, inv.reshape(-1), diff)
            seen = np.zeros((len(names), len(names)))
            np.add.at(seen, (y[:-1].reshape(-1), y[1:].reshape(-1)), 1.0)
            rows, at = np.unique(feat, return_inverse=True)
            gw = np.zeros((len(rows), len(names)), dtype=np.float32)
            np.add.at(gw, at, np.repeat(word, size, axis=0))
            gw -= DECAY * m.w[rows]
            g_w[rows] += gw * gw
            m.w[rows] += RATE * gw / np.sqrt(g_w[rows])
            for value, acc, g in ((m.lex, g_lex, listed[uniq].T @ word), (m.trans, g_t, (seen - expected) / x.shape[1]),
                                  (m.begin, g_b, (gold[0] - prob[0]).mean(axis=0))):
                acc += g * g
                value += RATE * g / np.sqrt(acc)
    return m


def fit(labelled: DataFrame, per_lang: int = DOCS_PER_LANG) -> Crf | None:
    """Model from ``labelled(doc_id, text, lang)``: at most ``per_lang`` documents of each language, chosen by hash.
    The sample is bounded, so one task may hold it; None if nothing is labelled."""
    has = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = (has.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("r", rank).where(F.col("r") <= per_lang)
           .select(F.col("doc_id").alias("s_id"), F.col("lang").alias("s_lang")).distinct())
    # at most per_lang ids a language
    sample = has.join(F.broadcast(ids), (F.col("doc_id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang"))).select("doc_id", "lang", "text")

    def run(t):
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        return pa.table({"model": pa.array([train(t["text"].to_pylist(), t["lang"].to_pylist()).dump()], pa.binary())})

    got = sample.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "model binary").first()
    return Crf.load(got["model"]) if got else None


def label(texts: list[str | None], m: Crf):
    """Per text: None without letters, else (summed label probabilities, words, runs of equal labels as
    (language, first word, number of words))."""
    number: dict[str, int] = {}
    put = number.setdefault
    coded = [np.array([put(w, len(number)) for w in words_of(t)], dtype=np.int32) for t in texts]
    emit = m.emissions(list(number))
    out: list = [None] * len(texts)
    order = sorted((k for k in range(len(texts)) if len(coded[k])), key=lambda k: -len(coded[k]))
    at = 0
    while at < len(order):
        n = max(1, CHUNK_WORDS // len(coded[order[at]]))
        part = order[at:at + n]
        at += n
        lengths = np.array([len(coded[k]) for k in part])
        e = np.zeros((lengths[0], len(part), len(m.langs)), dtype=np.float32)
        for i, k in enumerate(part):
            e[:lengths[i], i] = emit[coded[k]]
        prob, _ = m.marginals(e, lengths)
        for i, k in enumerate(part):
            mine = prob[:lengths[i], i]
            best = mine.argmax(axis=1)
            cut = np.concatenate(([0], np.flatnonzero(best[1:] != best[:-1]) + 1, [len(best)]))
            runs = [(m.langs[best[a]], int(a), int(z - a)) for a, z in zip(cut[:-1], cut[1:])]
            out[k] = (mine.sum(axis=0, dtype=np.float64), len(best), runs)
    return out


def identify(docs: DataFrame, model: Crf | None) -> DataFrame:
    """``(doc_id, lang_pred, score, n_words, spans)`` of every row: the language with the largest expected number of
    words, its share of them, and the runs of words by language (``lang, first, words``).

    Text that is null or without letters (or a model that had nothing to learn from) gives ``und`` with score 0.
    Repeated rows get equal results; ties go to the first language by name; extra columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dump() if model else None)
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches):
        m = Crf.load(shared.value) if shared.value else None
        for b in batches:
            found = label(b.column(1).to_pylist(), m) if m else [None] * b.num_rows
            pred, score, n, spans = [], [], [], []
            for x in found:
                pred.append(m.langs[int(x[0].argmax())] if x else "und")
                score.append(min(1.0, float(x[0].max() / x[0].sum())) if x else 0.0)
                n.append(x[1] if x else 0)
                spans.append([dict(zip(("lang", "first", "words"), r)) for r in x[2]] if x else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(n, pa.int64()), pa.array(spans, span)],
                                             names=["doc_id", "lang_pred", "score", "n_words", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, n_words long, spans array<struct<lang:string,first:int,words:int>>")


def op2_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(doc_bucket(5) != 0))
    return identify(docs, model).select("doc_id", F.coalesce(doc_bucket(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score",
                                        "n_words", F.size("spans").alias("n_spans"))
