"""Log-probabilities of texts under a hashed maximum-entropy language model.

Tokens are lower-cased (A-Z) words and one end of text.  One pass counts every word of the training texts exactly; the
counts stay a table in the shared folder and grow with the corpus.  What is broadcast of it is bounded: the words above the
least count that at most ``KNOWN`` words reach.

The model factors a token into three parts.  Its unit is one of ``WIDTH`` x ``WIDTH``: the end, the most frequent words, and
for all other words buckets by their last three bytes.  A unit's class and its place in the class each come from a softmax
over ``WIDTH`` outcomes, whose scores add up rows of one hashed table: a row for each n-gram or skip feature (the unit before, the pair of
the last two, and the second last alone), and for the second softmax each feature joined with the class.  Biases are
the logarithms of the training counts of units.  Inside a bucket a word has its smoothed share (c + 0.1 of the bucket's words
and one unknown word).  So the probabilities of all words and of an unknown word of each bucket add up to one after any history.

Training is distributed gradient ascent over all training texts, once: in each of ``ROUNDS`` rounds every task takes small
batches of its share, adds the gradient of the log-likelihood to its copy of the table (the expected feature counts
by one outcome drawn from the model's own softmax for each token, which is unbiased), and returns the rows it touched; rows
are averaged by the tokens that touched them, block by block, up a tree of groups.  A task has about ``TASK_TOKENS`` tokens, so what moves
follows the input.  Texts are scored in sparse batches: of each token only its rows are gathered.  Counts of words beyond those
broadcast are joined by word.  Texts become units once, two bytes a token, in a table that training and scoring read.

Defined cases: a null or empty text is its end alone.  A null doc_id is never held out and never trains.  Without training
texts every base score is 0 and units are uniform over the buckets.  Repeated rows are scored, and train, each for itself.
Extra columns make no difference.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import written
from .sampling import bucket_of

SMOOTH = 0.1
#: Outcomes of each softmax, and units that are single tokens; the other units are buckets.
WIDTH = 32
UNITS = WIDTH * WIDTH
SINGLE = UNITS // 2
#: Rows of the hashed table as a power of two, words broadcast at most.
ROW_BITS, KNOWN = 17, 1 << 18
ROUNDS, TASK_TOKENS, LEAST_TASKS, BATCH, RATE = 2, 6_000_000, 6, 8_192, 1.0
#: Rows of a matrix product at once, below what the library deals to threads.
TILE = 256
#: Bound of an outcome's score, which keeps its exponential within single precision.
SCORE = 80.0
#: Rows of a message, partitions that a group adds up, bytes of text handled at once.
BLOCK, FAN, PIECE = 512, 64, 1 << 24
#: The end of a text: no word holds white space.
END = "\n"


def bucket(word: bytes) -> int:
    """The unit of a word that is no unit of its own."""
    return SINGLE + zlib.crc32(word[-3:]) % (UNITS - SINGLE)


def bucket_column(word: Column) -> Column:
    return F.lit(SINGLE) + F.pmod(F.crc32(F.substring(word.cast("binary"), F.greatest(F.length(word.cast("binary")) - 2, F.lit(1)), F.lit(3))), F.lit(UNITS - SINGLE)).cast("int")


# ---- counts ----------------------------------------------------------------------------------------------------


def training(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.where(bucket_of(id_col, 10) != 0)


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last row of runs of texts of about ``PIECE`` bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    a, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > PIECE:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(size):
        yield a, len(size)


def word_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of texts end to end, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, doc = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    solid = pc.greater(pc.binary_length(words), 0)  # white space at an edge of a text leaves an empty word
    return words.filter(solid), doc[solid.to_numpy(zero_copy_only=False)]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows; the word "\\n" counts the ends."""

    def count(batches):
        for batch in batches:
            texts = batch.column(0)
            for a, b in runs(texts):
                found = pc.value_counts(word_arrays(texts.slice(a, b - a))[0])
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([len(texts)], pa.int64())], ["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What every task needs of the counts: totals, the frequent words with their counts and units, and the mass of each unit."""

    def __init__(self, total: int, distinct: int, words: list[str], counts: list[int], mass: np.ndarray, types: np.ndarray):
        """words: by falling count; mass and types: training tokens and words that fall in each bucket, single units included."""
        self.total, self.distinct = total, distinct
        order = sorted(range(len(words)), key=lambda i: (words[i] != END, -counts[i], words[i]))
        self.words = [words[i] for i in order]
        self.counts = np.array([counts[i] for i in order], np.int64)
        if not self.words or self.words[0] != END:
            self.words, self.counts = [END, *self.words], np.concatenate(([0], self.counts))
        raw = [w.encode() for w in self.words]
        self.unit = np.array([i if i < SINGLE else bucket(w) for i, w in enumerate(raw)], np.int64)
        single = np.zeros(SINGLE)
        single[: min(SINGLE, len(raw))] = self.counts[:SINGLE] + SMOOTH
        mass, types = mass.astype(float), types.astype(float)
        for w, n in zip(raw[1:SINGLE], self.counts[1:SINGLE]):
            mass[bucket(w)] -= n
            types[bucket(w)] -= 1
        self.mass = np.where(np.arange(UNITS) < SINGLE, np.concatenate((single, np.zeros(UNITS - SINGLE))), mass + SMOOTH * (types + 1))
        self.base_total = total + SMOOTH * (distinct + 1)


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """From the written table of counts."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("n") * 16).cast("int")
    left, least = known, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("n").alias("least")).collect(), key=lambda r: -r["step"]):  # at most 16 rows for each doubling of a count
        left -= r["n"]
        if left < 0:
            break
        least = r["least"]
    often = counts.where((F.col("n") >= least) | (F.col("word") == END) if least is not None else F.col("word") == END).toArrow()  # ``known`` words and the end
    mass, types = np.zeros(UNITS, np.int64), np.zeros(UNITS, np.int64)
    for r in counts.where(F.col("word") != END).groupBy(bucket_column(F.col("word")).alias("u")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():  # a row for each bucket
        mass[r["u"]], types[r["u"]] = r["n"], r["k"]
    return Vocabulary(total, distinct, often["word"].to_pylist(), often["n"].to_pylist(), mass, types)


# ---- the model -------------------------------------------------------------------------------------------------

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def histories(units: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A key for each feature (rows) of each token's history; ``before``: the two units ahead of the first.  Nothing is seen beyond an end (unit 0)."""
    u = np.concatenate((before, units))
    n = len(units)
    one = u[1 : 1 + n]
    two = np.where(one == 0, 0, u[:n])
    return np.stack((one, two + UNITS, one * UNITS + two + 2 * UNITS)).astype(np.uint64)


def rows_of(keys: np.ndarray, classes: np.ndarray | None, bits: int) -> np.ndarray:
    """Rows of the hashed table: of each feature alone, or joined with the class."""
    with np.errstate(over="ignore"):
        h = keys * _ODD[0]
        if classes is not None:
            h = (h ^ (h >> np.uint64(29))) + (classes.astype(np.uint64) + np.uint64(1)) * _ODD[1]
        h = (h ^ (h >> np.uint64(31))) * _ODD[2]
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Model:
    def __init__(self, vocab: Vocabulary, bits: int = ROW_BITS):
        self.total, self.bits = vocab.total, bits
        self.table = np.zeros((1 << bits, WIDTH), np.float32)
        self.seen = np.zeros(1 << bits, np.float32)
        mass = vocab.mass.reshape(WIDTH, WIDTH)
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(mass.sum(axis=1) / mass.sum()), -SCORE).astype(np.float32)
            self.unit_bias = np.maximum(np.log(mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-30)), -SCORE).astype(np.float32)

    def softmax(self, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the exponentials of its outcomes' scores, which are kept within +-SCORE, and their sum."""
        z = np.take(self.table, rows[0], axis=0)
        for r in rows[1:]:
            z += np.take(self.table, r, axis=0)
        z += bias
        np.clip(z, -SCORE, SCORE, out=z)
        np.exp(z, out=z)
        return z, _times(z, _ONE)

    def levels(self, units: np.ndarray, keys: np.ndarray):
        """Both softmaxes of tokens: rows, biases, outcome."""
        c, m = units // WIDTH, units % WIDTH
        yield rows_of(keys, None, self.bits), self.class_bias[None, :], c
        yield rows_of(keys, c, self.bits), np.take(self.unit_bias, c, axis=0), m

    def log10(self, units: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's unit."""
        out = np.zeros(len(units))
        for part, keys in _batches(units, before):
            for rows, bias, y in self.levels(units[part], keys):
                z, s = self.softmax(rows, bias)
                out[part] += np.log10(z[np.arange(len(y)), y].astype(float)) - np.log10(s)
        return out

    def learn(self, units: np.ndarray, before: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """Gradient steps over batches of tokens; a row's step falls with the root of the tokens that touched it."""
        flat = self.table.reshape(-1)
        for part, keys in _batches(units, before):
            for rows, bias, y in self.levels(units[part], keys):
                z, s = self.softmax(rows, bias)
                drawn = _drawn(z, rng.random(len(y), np.float32) * s)
                off = np.flatnonzero(drawn != y)
                np.add.at(self.seen, rows.ravel(), np.float32(1))
                rows = rows[:, off]
                step = (rate / np.sqrt(self.seen[rows] + 8)).astype(np.float32).ravel()
                rows *= WIDTH
                np.add.at(flat, (rows + y[off]).ravel(), step)
                np.subtract.at(flat, (rows + drawn[off]).ravel(), step)


_ONE, _UPPER = np.ones(WIDTH, np.float32), np.triu(np.ones((WIDTH, WIDTH), np.float32))


def _times(z: np.ndarray, m: np.ndarray) -> np.ndarray:
    """z @ m by tiles of rows so small that each is multiplied in the calling thread: the library's own threads spin against those of other tasks."""
    n = len(z) - len(z) % TILE
    out = np.empty((len(z), *m.shape[1:]), z.dtype)
    np.matmul(z[:n].reshape(-1, TILE, len(m)), m, out=out[:n].reshape(-1, TILE, *m.shape[1:]))
    np.matmul(z[n:], m, out=out[n:])
    return out


def _drawn(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The outcome of each row whose running sum first exceeds a number: running sums rise, so it is the number of those that do not, by bit counts."""
    beyond = np.packbits(_times(z, _UPPER) > at[:, None], axis=1).view(np.uint32)
    return np.minimum(WIDTH - np.bitwise_count(beyond[:, 0]).astype(np.int64), WIDTH - 1)


def _batches(units: np.ndarray, before: np.ndarray):
    """Slices of BATCH tokens and the keys of their histories."""
    for a in range(0, len(units), BATCH):
        part = slice(a, min(a + BATCH, len(units)))
        yield part, histories(units[part], units[a - 2 : a] if a else before)


# ---- texts as units --------------------------------------------------------------------------------------------

_ENCODED = "row long, doc_id long, held_out boolean, share int, n_tokens long, n_known long, base_score double, own_score double, units binary, rare array<struct<word:string,n:long>>"


def encode(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text once: its units (two bytes a token, the end last), what its tokens add to both scores apart from the model, its words that are not broadcast, and the round that trains on it (null: none)."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)  # at most ``known`` words and UNITS numbers

    def run(batches):
        v = held.value
        known_words = pa.array(v.words, pa.string())
        base_of = np.log10((v.counts + SMOOTH) / v.base_total)
        inside = np.where(v.unit < SINGLE, 0.0, np.log10((v.counts + SMOOTH) / v.mass[v.unit]))  # a word's share of its unit
        rest, base_rest = -np.log10(v.mass), -np.log10(v.base_total)  # of a word that is not broadcast, but for its count
        for batch in batches:
            for a, b in runs(batch.column(3)):
                part = batch.slice(a, b - a)
                size = part.num_rows
                words, doc = word_arrays(part.column(3))
                ids = pc.fill_null(pc.index_in(words, value_set=known_words), -1).to_numpy(zero_copy_only=False)
                miss = ids < 0
                here = np.where(miss, 0, ids)
                units = v.unit[here]
                units[miss] = buckets(rare := words.filter(pa.array(miss)))
                add = lambda x: np.bincount(doc, x, size)  # noqa: B023, E731
                tokens = np.bincount(doc, minlength=size) + 1  # and the end
                known = add((v.counts[here] > 0) & ~miss).astype(np.int64) + int(v.counts[0] > 0)
                base = add(np.where(miss, base_rest, base_of[here])) + base_of[0]
                own = add(np.where(miss, rest[units], inside[here]))
                edge = np.concatenate(([0], np.cumsum(tokens)))
                flat = np.zeros(edge[-1], np.uint16)
                flat[np.arange(len(doc)) + doc] = units
                coded = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer((2 * edge).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), part.column(4), *map(pa.array, (tokens, known, base, own)), coded, counted(rare, doc[miss], size)], ["row", "doc_id", "held_out", "share", "n_tokens", "n_known", "base_score", "own_score", "units", "rare"])

    fold = bucket_of(id_col, 10)
    share = F.when(fold != 0, F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(rounds)).cast("int"))
    cols = [F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), share.alias("share")]
    return docs.select(*cols).mapInArrow(run, _ENCODED)


def buckets(words: pa.Array) -> np.ndarray:
    """The bucket of each word, by its last three bytes."""
    tails = pc.binary_slice(words.cast(pa.binary()), -3).dictionary_encode()
    code = np.array([bucket(t) for t in tails.dictionary.to_pylist()], np.int64)
    return code[tails.indices.to_numpy()] if len(words) else code


def counted(words: pa.Array, doc: np.ndarray, size: int) -> pa.Array:
    """For each of ``size`` texts the list of its different words with their counts."""
    got = pa.table({"d": pa.array(doc), "word": words}).group_by(["d", "word"]).aggregate([([], "count_all")]).combine_chunks().sort_by("d")
    edge = np.concatenate(([0], np.cumsum(np.bincount(got["d"].to_numpy(), minlength=size)))).astype(np.int32)
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (got["word"], got["count_all"])]
    return pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays(flat, ["word", "n"]))


def units_of(column: pa.Array) -> np.ndarray:
    """The units of a batch's texts end to end."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).astype(np.int64)


_TABLE = "block int, part int, body binary"


def _pack(rows: np.ndarray, seen: np.ndarray, change: np.ndarray) -> bytes:
    return b"".join((np.uint32(len(rows)).tobytes(), rows.astype(np.uint16).tobytes(), seen.astype(np.float32).tobytes(), change.astype(np.float16).tobytes()))


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    return np.frombuffer(body, np.uint16, n, 4).astype(np.int64), np.frombuffer(body, np.float32, n, 4 + 2 * n), np.frombuffer(body, np.float16, n * WIDTH, 4 + 6 * n).reshape(n, WIDTH)


def _merge(bodies: list[bytes]) -> bytes:
    """Changes of rows averaged by the tokens that touched them, tokens added up."""
    seen, change = np.zeros(BLOCK), np.zeros((BLOCK, WIDTH))
    for body in bodies:
        rows, n, d = _unpack(body)
        seen[rows] += n
        change[rows] += n[:, None] * d
    rows = np.flatnonzero(seen)
    return _pack(rows, seen[rows], change[rows] / seen[rows, None])


def _round(model: Model, encoded: DataFrame, parts: int, rate: float) -> None:
    """One round of all tasks over their shares; the model's table takes the averaged changes."""
    held = encoded.sparkSession.sparkContext.broadcast(model)  # 2^ROW_BITS rows

    def climb(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own, rng, before = Model.__new__(Model), np.random.default_rng(part), np.zeros(2, np.int64)
        own.__dict__.update(held.value.__dict__)
        own.table, own.seen = held.value.table.copy(), held.value.seen.copy()
        for batch in batches:
            units = units_of(batch.column(0))
            own.learn(units, before, rng, rate)
            before = np.concatenate((before, units))[-2:]
        seen = own.seen - held.value.seen
        for b in range(0, len(seen), BLOCK):
            rows = np.flatnonzero(seen[b : b + BLOCK])
            if len(rows):
                body = _pack(rows, seen[b + rows], own.table[b + rows] - held.value.table[b + rows])
                yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([body], pa.binary())], ["block", "part", "body"])

    def add(key, t: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "body": pa.array([_merge(t.column("body").to_pylist())], pa.binary())})

    told = encoded.select("units").coalesce(parts).mapInArrow(climb, _TABLE)
    level = parts
    while level > 1:
        told = told.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("block", "part").applyInArrow(lambda key, t: add(key, t), _TABLE)
        level = -(-level // FAN)
    for r in told.collect():  # one table: 2^ROW_BITS rows
        rows, n, change = _unpack(bytes(r["body"]))
        rows = rows + r["block"] * BLOCK
        model.table[rows] += change
        model.seen[rows] += n
    held.destroy()


def train(encoded: DataFrame, vocab: Vocabulary, bits: int = ROW_BITS, rounds: int = ROUNDS, rate: float = RATE, task_tokens: int = TASK_TOKENS) -> Model:
    """A model of the training texts: each of them in one round, by a hash of its id."""
    model = Model(vocab, bits)
    parts = max(LEAST_TASKS, -(-vocab.total // (rounds * task_tokens)))
    for k in range(rounds):
        _round(model, encoded.where(F.col("share") == k), parts, rate)
    return model


# ---- scores ----------------------------------------------------------------------------------------------------


def score(encoded: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of encoded texts."""
    held = encoded.sparkSession.sparkContext.broadcast(model)  # 2^ROW_BITS rows
    cols = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def run(batches):
        for batch in batches:
            units = units_of(batch.column("units"))
            at = np.repeat(np.arange(batch.num_rows), batch.column("n_tokens").to_numpy())
            own = np.bincount(at, held.value.log10(units, np.zeros(2, np.int64)), batch.num_rows) + batch.column("own_score").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(own)], [*cols, "score"])

    told = encoded.select(*cols, "own_score", "units").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    each = encoded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("k"))
    # no word among these is frequent: those are broadcast
    found = each.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("own"))
    own = F.coalesce("own", F.lit(0.0))
    return told.join(found, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base_score") + own).alias("base_score"), (F.col("score") + own).alias("score"))


def log_probabilities(docs: DataFrame, known: int = KNOWN, bits: int = ROW_BITS, rounds: int = ROUNDS, rate: float = RATE, task_tokens: int = TASK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count, encode, train and score one table."""
    counts = written(word_counts(training(docs, id_col), text_col))
    vocab = vocabulary(counts, known)
    encoded = written(encode(docs, vocab, rounds, id_col, text_col))
    return score(encoded, train(encoded, vocab, bits, rounds, rate, task_tokens), counts)
