"""SentencePiece encoding and decoding by a lattice of pieces.

Words (a blank and what follows it, cut further where no piece of the vocabulary could cross) are exploded into
substrings of bounded length, equi-joined to the piece table and grouped by word into edges; the best path is folded
over the word's positions with Spark's higher-order ``aggregate``. That relational lattice encodes the most frequent
words (at most ``HEAD_WORDS``: a bounded codebook that is broadcast). Any other word goes through the same lattice
inside the task that meets it, because joining every occurrence of a rare word would shuffle more than the texts.
The vocabulary is a public one, given by path; a path's score is the sum over its pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipledger.llm.common import head_of, saved, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_SCORE = -100_000.0    # of a byte piece: below all others, so bytes stand only where they must
HEAD_WORDS = 1 << 17       # words of the codebook
CACHED_WORDS = 1 << 17     # rare words a task remembers before it starts anew
SLICE = 256                # documents encoded together
LONG_WORD = 48             # longer words are encoded one by one
MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    score: dict[str, float]      # piece (blank for the mark) -> score
    number: dict[str, int]       # piece -> id
    own: list[int]               # byte -> id of its byte piece
    longest: int
    text: list[bytes]            # id -> bytes
    pattern: str                 # cuts a text into words that no piece crosses


def load_pieces(path: str = MODEL) -> Pieces:
    """The piece table of a SentencePiece model with byte fallback; control and unknown pieces decode to nothing."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    score, number, own, text = {}, {}, [0] * 256, []
    for i in range(m.vocab_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            own[int(p[3:-1], 16)] = i
            text.append(bytes([int(p[3:-1], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            text.append(b"")
        else:
            p = p.replace("▁", " ")
            score[p], number[p] = float(m.get_score(i)), i
            text.append(p.encode())
    return Pieces(score, number, own, max(map(len, score)), text, _word_pattern(score))


def _word_pattern(score: dict[str, float]) -> str:
    """Blanks, then a run of letters or a run of what is neither letter nor blank. Letters that share a piece with
    such characters count as these; a vocabulary whose pieces still cross a cut is refused."""
    letter, moved = re.compile(r"[^\W\d_]"), ""
    for _ in range(2):
        m = re.escape(moved)
        pattern = rf" *[^\W\d_{m}]+| *(?:[^\w ]|[\d_{m}])+| +"
        crossing = [p for p in score if not re.fullmatch(pattern, p)]
        if not crossing:
            return pattern
        moved = "".join(sorted({c for p in crossing for c in p if letter.match(c) and not c.isalpha()}))
    raise ValueError(f"pieces cross the word cuts: {crossing[:5]}")


def words_of(text: str | None, pattern: re.Pattern) -> list[str]:
    """Words of the whole text with a blank put in front; their concatenation is that text."""
    return pattern.findall(" " + text) if text else []


def encode_word(word: str, pieces: Pieces) -> tuple[int, ...]:
    """Best path of one word: substrings of bounded length are looked up, their edges folded from left to right. Of
    equal scores the one with the shortest last piece stands."""
    n, score, longest = len(word), pieces.score, pieces.longest
    best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    for z in range(1, n + 1):
        for a in range(z - 1, max(-1, z - 1 - longest), -1):
            s = score.get(word[a:z])
            if s is None:
                if a < z - 1:
                    continue
                s = BYTE_SCORE * len(word[a].encode("utf-8", "surrogatepass"))
            if best[a] + s > best[z]:
                best[z], back[z] = best[a] + s, a
    out, z = [], n
    while z:
        a = back[z]
        i = pieces.number.get(word[a:z])
        out.append([i] if i is not None else [pieces.own[b] for b in word[a:z].encode("utf-8", "surrogatepass")])
        z = a
    return tuple(i for part in reversed(out) for i in part)


class ArrayLattice:
    """The lattice of many words at once: their substrings are hashed length by length, joined to the piece table by
    hash, and the best path is folded over positions for all words together. Same paths as ``encode_word``."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.by_length = pieces, {}
        for n in range(1, pieces.longest + 1):
            own = [p for p in pieces.score if len(p) == n]
            if not own:
                continue
            h = self._hash(np.array(own, dtype=f"U{n}").view(np.uint32).reshape(-1, n).astype(np.uint64))
            order = np.argsort(h)
            there = np.zeros(1 << 18, dtype=bool)
            there[h >> np.uint64(46)] = True
            self.by_length[n] = (h[order], np.array([pieces.score[p] for p in own])[order], there)

    @staticmethod
    def _mix(h, code):
        h = (h ^ code) * MULT
        return h ^ (h >> np.uint64(31))

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        h = np.full(len(codes), 7, dtype=np.uint64)
        for k in range(codes.shape[1]):
            h = self._mix(h, codes[:, k])
        return h

    def encode(self, words: list[str]) -> list[bytes]:
        """ids of every word as little-endian int32 bytes."""
        out = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 4096):
            part = order[at:at + 4096]
            short = [i for i in part if 0 < len(words[i]) <= LONG_WORD]
            for i in part:
                if len(words[i]) > LONG_WORD:
                    out[i] = np.array(encode_word(words[i], self.pieces), dtype="<i4").tobytes()
            for i, ids in zip(short, self._paths([words[i] for i in short])):
                out[i] = ids
        return out

    def _paths(self, words: list[str]):
        if not words:
            return
        n, number, own = max(map(len, words)), self.pieces.number, self.pieces.own
        codes = np.array(words, dtype=f"U{n}").view(np.uint32).reshape(-1, n).astype(np.uint64)
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64)
        h = np.full(codes.shape, 7, dtype=np.uint64)
        scores = []
        for k in range(1, min(self.pieces.longest, n) + 1):
            h = self._mix(h[:, :n - k + 1], codes[:, k - 1:])
            s = BYTE_SCORE * size if k == 1 else np.full(h.shape, -np.inf)
            if k in self.by_length:
                key, score, there = self.by_length[k]
                flat = h.reshape(-1)
                maybe = np.flatnonzero(there[flat >> np.uint64(46)])
                pos = np.minimum(np.searchsorted(key, flat[maybe]), len(key) - 1)
                hit = key[pos] == flat[maybe]
                s.reshape(-1)[maybe[hit]] = score[pos[hit]]
            scores.append(s)
        best = np.full((len(words), n + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((len(words), n + 1), dtype=np.int8)
        for z in range(1, n + 1):
            for k in range(1, min(len(scores), z) + 1):
                new = best[:, z - k] + scores[k - 1][:, z - k]
                up = new > best[:, z]
                best[up, z] = new[up]
                back[up, z] = k
        for w, steps in zip(words, back.tolist()):
            ids, z = [], len(w)
            while z:
                a = z - steps[z]
                i = number.get(w[a:z])
                ids.append([i] if i is not None else [own[b] for b in w[a:z].encode("utf-8", "surrogatepass")])
                z = a
            yield np.array([i for part in reversed(ids) for i in part], dtype="<i4").tobytes()


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``(word)``, distinct, neither null nor empty -> ``(word, ids)``: the same best path, in relations.

    The piece table has the vocabulary's size (fixed by the model file), so it is broadcast; substrings are no
    longer than the longest piece. The fold's state is the last ``longest`` + 1 positions."""
    vocab = F.broadcast(words.sparkSession.createDataFrame(
        [(p, pieces.number[p], s) for p, s in pieces.score.items()], "piece string, id int, score double"))
    n = F.char_length("word")
    parts = (words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("z"))
             .select("word", "z", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("z")))).alias("len"))
             .withColumn("sub", F.substring("word", F.col("z") - F.col("len") + 1, F.col("len"))))
    hit = parts.join(vocab, F.col("sub") == F.col("piece"), "left").where("len = 1 or id is not null")
    edge = F.struct("z", "len", "id", F.coalesce("score", BYTE_SCORE * F.octet_length("sub")).alias("score"),
                    F.when(F.col("id").isNull(), F.col("sub")).alias("raw"))
    edges = hit.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    own = F.array(*map(F.lit, pieces.own))

    def spelled(raw: Column) -> Column:
        digits = F.hex(raw.cast("binary"))
        return F.transform(F.sequence(F.lit(1), F.floor(F.length(digits) / 2).cast("int")),
                           lambda i: F.get(own, F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))

    def step(state: Column, e: Column) -> Column:
        # edges come by end: one of length 1 opens position z, the others may better it
        opens = e["len"] == 1
        past = F.element_at(state, F.when(opens, F.lit(-1)).otherwise(-1 - e["len"]))
        new = F.struct((past["score"] + e["score"]).alias("score"),
                       F.concat(past["ids"], F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(spelled(e["raw"]))).alias("ids"))
        keep = F.when(F.size(state) > pieces.longest, F.slice(state, 2, pieces.longest)).otherwise(state)
        body = F.slice(state, 1, F.size(state) - 1)
        return F.when(opens, F.concat(keep, F.array(new))).when(
            new["score"] > F.element_at(state, -1)["score"], F.concat(body, F.array(new))).otherwise(state)

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")))
    return edges.select("word", F.aggregate("edges", start, step, lambda s: F.element_at(s, -1)["ids"]).alias("ids"))


def word_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``(word, n)`` over all whole texts, counted per batch before the shuffle."""
    cut = re.compile(pieces.pattern)

    def run(batches):
        from collections import Counter
        for b in batches:
            total: Counter = Counter()
            for t in b.column(0):
                total.update(words_of(t.as_py(), cut))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def codebook(docs: DataFrame, pieces: Pieces, limit: int = HEAD_WORDS) -> DataFrame:
    """``(word, ids)`` of the most frequent words, at most ``limit``, from the relational lattice."""
    counts = saved(word_counts(docs, pieces), "sp-words")
    # a word of many thousand characters is no codebook entry: the tasks that meet it encode it
    head = head_of(counts.where(F.char_length("word") <= 64), limit)
    return lattice(head.select("word"), pieces)


def encode(docs: DataFrame, path: str = MODEL, head_words: int = HEAD_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ids (array of piece ids of the whole text), n_pieces and round_trip (the ids' bytes are the text);
    same rows, all columns or those of ``keep`` (columns of the three names are replaced). Null and empty texts have
    no pieces. Texts stay in their partitions."""
    pieces = load_pieces(path)
    spark = docs.sparkSession
    t = codebook(docs, pieces, head_words).toArrow()       # at most head_words rows
    head = {w: np.array(x, dtype="<i4").tobytes() for w, x in zip(t["word"].to_pylist(), t["ids"].to_pylist())}
    known = spark.sparkContext.broadcast((vars(pieces), head))     # plain data: workers need no copy of the class
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_pieces", "round_trip")]

    def run(batches):
        pieces, head = Pieces(**known.value[0]), known.value[1]
        array, cut, seen, raw = ArrayLattice(pieces), re.compile(pieces.pattern), {}, pieces.text
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                texts = b.column(b.num_columns - 1).to_pylist()
                split = [words_of(x, cut) for x in texts]
                if len(seen) > CACHED_WORDS:
                    seen = {}
                new = list({w for ws in split for w in ws if w not in head and w not in seen})
                seen.update(zip(new, array.encode(new)))
                ids = [np.frombuffer(b"".join([head.get(w) or seen[w] for w in ws]), dtype="<i4") for ws in split]
                same = [b"".join([raw[i] for i in x.tolist()])[1:] == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), values), pa.array(np.diff(ends), pa.int64()), pa.array(same)],
                    names=[*own, "ids", "n_pieces", "round_trip"])

    schema = T.StructType([*[docs.schema[c] for c in own], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return docs.select(*own, F.col("text").alias("text__")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded``: the text of ``ids``; pieces are put together as bytes, the blank in front goes."""
    table_ = encoded.sparkSession.sparkContext.broadcast(load_pieces(path).text)

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd
        t = table_.value
        return pd.Series([b"".join([t[i] for i in x]).decode("utf-8", "replace")[1:] if x is not None else "" for x in ids], dtype=object)

    return encoded.withColumn("decoded", text("ids"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
