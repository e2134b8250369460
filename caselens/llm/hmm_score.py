"""Language-model scores of texts by a hidden Markov model, trained with Baum-Welch over all training documents.

Words of all training documents are counted exactly. The SYMBOLS most frequent
are symbols of the model; any other word is emitted in two steps, first one of
a few classes by its form (a symbol as well), then the word within its class,
by its own count. That second step does not depend on the state, so it leaves
the recursion and is summed apart - over the exact counts of all words, rare
and unseen ones included.

Tasks run the scaled forward-backward recursion over their documents and send
expected counts in blocks, which streams of partial sums add up; the driver
gets only the model, whose size is bounded. Training documents are dealt over
SLICES by hash. A sweep goes through all of them and refits the model after each
slice, from a running mean of expected counts (stepwise Baum-Welch, which needs
far fewer passes than one refit a pass). Sweeps end when the likelihood gains
little; a last round, over all documents at once, gives the model. Scores are
exact likelihoods of whole texts: the scaled forward recursion runs over every
token.

Counts of the HOT most frequent words, and of the HOT_LONG most frequent long
ones (named by 128 bits), are broadcast, a bounded number; words beyond them go
to a join with the table of all counts, in which no key is common.

Edge cases: null and empty texts consist of the end token; a null doc_id hashes
as an empty one, which is held out; rows repeated with doc_id and text get a
row each and count as often; without training documents all counts are 0.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bpe import WORD
from ._spark import arrow, most_frequent, partitions, small_batches, stash
from ._text import slices

STATES = 6
SYMBOLS = 48_000
HOT, HOT_LONG = 300_000, 20_000
#: Hot words have at most so many bytes; longer ones are known by their digests.
HOT_BYTES = 48
#: Slices of the training documents in a sweep; the weight of the n-th slice in the running mean is (n + 1) ** -FADE.
SLICES, FADE = 8, 0.3
#: Sweeps, or rounds, end when one gains less than GAIN (log10 of the likelihood, per token).
GAIN = 2e-3
#: No more sweeps, or rounds, than these, should the gain not get small. Three sweeps do what some eleven rounds do.
SWEEPS, ROUNDS = 3, 200
BLOCKS = 64
#: Tokens that a task holds at once.
_HOLD = 1_000_000
#: Forms of words that are not symbols, and the end of a text; they come first among the symbols.
END, LETTERS, DIGITS, MIXED, FOREIGN = range(5)
CLASSES = 5

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_PARTS = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("n_tokens", pa.int64()),
        ("known", pa.int64()), ("base_logs", pa.float64()), ("class_logs", pa.float64()), ("word", pa.string()), ("freq", pa.int64()),
    ]
)
_PARTS_DDL = "doc_id bigint, text_key bigint, held_out boolean, ids binary, n_tokens bigint, known bigint, base_logs double, class_logs double, word string, freq bigint"


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.encode().lower().decode()) if text else []


def form(word: str) -> int:
    if not word.isascii():
        return FOREIGN
    if word.isalpha():
        return LETTERS
    return DIGITS if any(c.isdigit() for c in word) else MIXED


def _form_column(word: str) -> Column:
    """form() as a column."""
    w = F.col(word)
    return F.when(w.rlike(r"[^\x00-\x7F]"), FOREIGN).when(w.rlike(r"^[A-Za-z]+$"), LETTERS).when(w.rlike(r"[0-9]"), DIGITS).otherwise(MIXED)


def _send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = Counter()
    for batch in slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            total.update(words_of(text))
        if len(total) > 600_000:
            yield arrow(None, _COUNTS, word=list(total), n=list(total.values()))
            total.clear()
    yield arrow(None, _COUNTS, word=list(total), n=list(total.values()))


@dataclass
class Counts:
    """What tasks need to know of the counts of training tokens; bounded by HOT."""

    words: list[str]
    long: dict[str, int]
    counts: np.ndarray
    forms: np.ndarray
    symbols: int
    ends: int
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def base(self) -> float:
        return float(np.log10(self.total + 0.1 * (self.distinct + 1)))

    @property
    def class_base(self) -> np.ndarray:
        return np.log10(self.class_total + 0.1 * (self.class_distinct + 1))


def count_words(docs: DataFrame, symbols: int = SYMBOLS, hot: int = HOT) -> tuple[DataFrame, Counts]:
    """(word, n) over the training documents, and the bounded part of it."""
    training = docs.filter(~held_out())
    table = stash(training.select("text").mapInArrow(_send_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    top = most_frequent(table.filter(F.octet_length("word") <= HOT_BYTES), "n", hot)
    long = most_frequent(table.filter(F.octet_length("word") > HOT_BYTES), "n", min(hot, HOT_LONG))
    long = {r[0]: r[1] for r in long.select(F.md5("word"), "n").collect()}
    rows = sorted(((r[0], r[1]) for r in top.collect()), key=lambda r: (-r[1], r[0]))
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    class_total, class_distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, n, d in table.groupBy(_form_column("word").alias("form")).agg(F.sum("n"), F.count("*")).collect():
        class_total[k], class_distinct[k] = n, d
    counts, forms = np.array([n for _, n in rows], np.float64), np.array([form(w) for w, _ in rows], np.int64)
    own = min(symbols, len(rows))
    for k in range(1, CLASSES):  # symbols are not among the words of a class
        mine = forms[:own] == k
        class_total[k] -= counts[:own][mine].sum()
        class_distinct[k] -= mine.sum()
    return table, Counts(
        [w for w, _ in rows], long, counts, forms, own, ends, total + ends, distinct + (ends > 0), class_total, class_distinct,
    )


class _Index(dict):
    """Hot words to their rank; other words are put down in rest."""

    def __missing__(self, word: str) -> int:
        self.rest.append(word)
        return -1 - form(word)


def _encode(batches: Iterator[pa.RecordBatch], known: Counts) -> Iterator[pa.RecordBatch]:
    """A row for each document (symbols, and logs of what hot words contribute), and one for each of its other words."""
    index = _Index(zip(known.words, range(len(known.words))))
    logs = np.log10(np.concatenate([known.counts, [1.0]]) + 0.1)
    symbol = np.where(np.arange(len(known.words)) < known.symbols, np.arange(len(known.words)) + CLASSES, known.forms).astype(np.uint16)
    end = np.log10(known.ends + 0.1)
    for batch in slices(batches, "text"):
        out = {f.name: [] for f in _PARTS}
        for doc_id, text, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out"))):
            key = int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little", signed=True)
            index.rest = []
            words = words_of(text)
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            hot = at[at >= 0]
            ids = np.append(np.where(at >= 0, symbol[np.maximum(at, 0)] if len(symbol) else 0, -1 - at), END).astype(np.uint16)
            rest = Counter(index.rest)
            of_long, n_long = 0.0, 0
            if known.long:
                for word in [w for w in rest if len(w) > HOT_BYTES // 4]:
                    if len(raw := word.encode()) > HOT_BYTES and (n := known.long.get(hashlib.md5(raw).hexdigest())) is not None:
                        freq = rest.pop(word)
                        of_long, n_long = of_long + freq * float(np.log10(n + 0.1)), n_long + freq
            in_class = hot[hot >= known.symbols]
            base_logs, class_logs = float(logs[hot].sum() + end) + of_long, float(logs[in_class].sum()) + of_long
            row = (doc_id, key, held, ids.tobytes(), len(ids), len(hot) + n_long + (known.ends > 0), base_logs, class_logs, None, None)
            for name, value in zip(out, row):
                out[name].append(value)
            for name, value in zip(out, (doc_id, key)):
                out[name] += [value] * len(rest)
            for name in list(out)[2:8]:
                out[name] += [None] * len(rest)
            out["word"] += list(rest)
            out["freq"] += list(rest.values())
        yield arrow(None, _PARTS, **out)


# --- the model --------------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def begin(frequency: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    """The frequencies of the symbols with random differences between the states, strong enough to part them soon."""
    rng = np.random.default_rng(seed)
    emit = (frequency[:, None] + 0.1) * rng.gamma(1.0, 1.0, (len(frequency), states))
    move = rng.gamma(1.0, 1.0, (states, states)) + 0.1
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def refit(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, prior: np.ndarray) -> Model:
    """The model of expected counts; every state keeps a little of the prior for each symbol."""
    starts, moves, emissions = starts + 0.1, moves + 0.1, emissions + prior[:, None]
    return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, active, flat ids by step, begin of each step): sequences by falling length, so those active at a step come first."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    steps = np.arange(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -steps, side="left")
    row = np.repeat(np.arange(len(order)), lengths[order])
    step = np.concatenate([np.arange(lengths[i]) for i in order]) if len(order) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(len(row), np.int64)
    flat[first[step] + row] = np.concatenate([sequences[i] for i in order]) if len(order) else []
    return order, active, flat, first


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of whole sequences, by the scaled forward recursion."""
    order, active, flat, first = _padded(sequences)
    logs = np.zeros(len(order))
    alpha = None
    for t, n in enumerate(active.tolist()):
        seen = model.emit[flat[first[t] : first[t] + n]]
        alpha = seen * model.start if t == 0 else (alpha[:n] @ model.move) * seen
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        logs[:n] += np.log10(scale)
    out = np.empty(len(order))
    out[order] = logs
    return out


def expect(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions (the forward-backward recursion)."""
    return _expect(model, sequences)[:3]


def _expect(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """expect(), and the log10 likelihood of all sequences."""
    states = len(model.start)
    order, active, flat, first = _padded(sequences)
    alphas, scales = np.empty((len(flat), states)), np.empty(len(flat))
    for t, n in enumerate(active.tolist()):
        a, b = first[t], first[t] + n
        seen = model.emit[flat[a:b]]
        alpha = seen * model.start if t == 0 else (alphas[first[t - 1] : first[t - 1] + n] @ model.move) * seen
        scales[a:b] = alpha.sum(axis=1)
        np.divide(alpha, scales[a:b, None], out=alphas[a:b])
    gamma = alphas
    moves, beta = np.zeros((states, states)), np.zeros((0, states))
    for t in range(len(active) - 1, -1, -1):
        a, n = first[t], int(active[t])
        now = np.ones((n, states))
        if len(beta):
            m = len(beta)
            ahead = model.emit[flat[first[t + 1] : first[t + 1] + m]] * beta / scales[first[t + 1] : first[t + 1] + m, None]
            moves += alphas[a : a + m].T @ ahead
            now[:m] = ahead @ model.move.T
        beta = now
        gamma[a : a + n] *= now  # alphas of this step are not needed any more
    starts = gamma[: int(active[0])].sum(axis=0) if len(active) else np.zeros(states)
    emissions = np.stack([np.bincount(flat, weights=gamma[:, k], minlength=len(model.emit)) for k in range(states)], axis=1)
    return starts, moves * model.move, emissions, float(np.log10(scales).sum())


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    held, ids, size = [], [], 0
    for batch in batches:
        for part in slices(iter([batch]), "ids", 2 * _HOLD):
            held.append(part)
            ids += [np.frombuffer(x, np.uint16) for x in part.column("ids").to_pylist()]
            size += int(sum(map(len, ids[-part.num_rows :])))
            if size > _HOLD:
                yield held, ids
                held, ids, size = [], [], 0
    if held:
        yield held, ids


_SUMS = pa.schema([("block", pa.int32()), ("sums", pa.binary())])


def _send_counts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Expected counts of a task: block 0 has the likelihood, starts and moves, the others parts of the emissions."""
    states = len(model.start)
    starts, moves, emissions, log = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape), np.zeros(1)
    for _, ids in _sequences(batches):
        for total, part in zip((starts, moves, emissions, log), _expect(model, ids)):
            total += part
    parts = [np.concatenate([log, starts, moves.ravel()]), *np.array_split(emissions, BLOCKS)]
    yield arrow(None, _SUMS, block=list(range(len(parts))), sums=[np.ascontiguousarray(x).tobytes() for x in parts])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block; only one sum of each is held."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            part = np.frombuffer(raw)
            totals[block] = totals[block] + part if block in totals else part.copy()
    yield arrow(None, _SUMS, block=list(totals), sums=[x.tobytes() for x in totals.values()])


def expected(sequences: DataFrame, model: Model, share: int = 1) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
    """(log10 likelihood, starts, moves, emissions) over a table of sequences (ids); None without any. A table of the model's own size comes to the driver.

    share: the part of the data that this is, one in so many; as many fewer tasks add up.
    """
    spark, states = sequences.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(model)
    sent = sequences.select("ids").mapInArrow(lambda it: _send_counts(it, shared.value), "block int, sums binary")
    added = sent.repartition(
        min(BLOCKS, max(1, partitions(spark) // (4 * share))), "block",
    ).mapInArrow(_add_up, "block int, sums binary").collect()
    shared.destroy()
    sums = {r[0]: np.frombuffer(bytes(r[1])) for r in added}
    if not sums:
        return None
    emissions = np.concatenate([sums[1 + k].reshape(-1, states) for k in range(BLOCKS)])
    if not emissions.any():
        return None
    return float(sums[0][0]), sums[0][1 : states + 1], sums[0][states + 1 :].reshape(states, states), emissions


def _prior(model: Model) -> np.ndarray:
    return np.full(len(model.emit), 0.02)


def baum_welch(sequences: DataFrame, model: Model, rounds: int = ROUNDS, gain: float = GAIN) -> Model:
    """Rounds over all sequences (ids, binary), each with one refit."""
    last = -np.inf
    for _ in range(rounds):
        if (sums := expected(sequences, model)) is None:
            break
        log, starts, moves, emissions = sums
        model = refit(starts, moves, emissions, _prior(model))
        if log - last < gain * emissions.sum():
            break
        last = log
    return model


def sliced(sequences: DataFrame, slices: int = SLICES) -> DataFrame:
    """sequences: doc_id, text_key, ids. Dealt by hash, and written with a folder for each slice; files number as partitions do."""
    n = partitions(sequences.sparkSession)
    key = F.xxhash64("doc_id", "text_key")
    part = F.pmod(F.shiftrightunsigned(key, 20), F.lit(max(1, n // slices)))
    return stash(
        sequences.select(
            F.pmod(key, F.lit(slices)).alias("slice"), part.alias("part"), "ids",
        ).repartition(n, "slice", "part").select("slice", "ids"),
        "slice",
    )


def learn(sequences: DataFrame, model: Model, sweeps: int = SWEEPS, gain: float = GAIN, slices: int = SLICES) -> Model:
    """sequences: of sliced(). Sweeps with a refit after each slice, then a round over all of them."""
    mean, n, last = None, 0, -np.inf
    for _ in range(sweeps):
        log, tokens = 0.0, 0.0
        for k in range(slices):
            if (sums := expected(sequences.filter(F.col("slice") == k), model, slices)) is None:
                continue
            own = sums[3].sum()
            log, tokens = log + sums[0], tokens + own
            weight = (n + 1) ** -FADE
            fresh = [x / own for x in sums[1:]]
            mean = fresh if mean is None else [m + weight * (x - m) for m, x in zip(mean, fresh)]
            n += 1
            model = refit(*(x * own * slices for x in mean), _prior(model))
        if not tokens or log / tokens - last < gain:
            break
        last = log / tokens
    return baum_welch(sequences, model, rounds=1)


_SCORED = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
        ("base_logs", pa.float64()), ("class_logs", pa.float64()),
    ]
)


def _score(batches: Iterator[pa.RecordBatch], model: Model, class_base: np.ndarray) -> Iterator[pa.RecordBatch]:
    """class_logs gets the likelihood of the symbols, and what the words of a class share."""
    for parts, ids in _sequences(batches):
        logs = forward(model, ids)
        logs -= np.array([class_base[x[(x < CLASSES) & (x != END)]].sum() for x in ids])
        table = pa.Table.from_batches(parts).drop_columns(["ids"])
        at = table.schema.get_field_index("class_logs")
        yield from table.set_column(
            at, "class_logs", pa.array(table.column("class_logs").to_numpy() + logs),
        ).select(_SCORED.names).combine_chunks().to_batches()


def hmm_scores(
    docs: DataFrame, states: int = STATES, symbols: int = SYMBOLS, hot: int = HOT, sweeps: int = SWEEPS, slices: int = SLICES,
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    table, known = count_words(docs, min(symbols, (1 << 16) - CLASSES), hot)
    shared = spark.sparkContext.broadcast(known)
    parts = stash(docs.withColumn("held_out", held_out()).mapInArrow(lambda it: _encode(it, shared.value), _PARTS_DDL))
    whole = parts.filter("word IS NULL")
    frequency = np.concatenate([[known.ends], np.maximum(known.class_total[1:], 0), known.counts[: known.symbols]])
    training = sliced(whole.filter("NOT held_out"), slices)
    model = spark.sparkContext.broadcast(learn(training, begin(frequency, states), sweeps, slices=slices))
    class_base = known.class_base
    scored = whole.select("ids", *_SCORED.names).mapInArrow(
        lambda it: _score(it, model.value, class_base),
        "doc_id bigint, text_key bigint, held_out boolean, n_tokens bigint, known bigint, base_logs double, class_logs double",
    )
    rare = parts.filter("word IS NOT NULL").select("doc_id", "text_key", "word", "freq").join(table, "word", "left")
    logs = F.log10(F.coalesce("n", F.lit(0)) + 0.1) * F.col("freq")
    rare = rare.groupBy("doc_id", "text_key").agg(
        F.sum(F.when(F.col("n") > 0, F.col("freq")).otherwise(0)).alias("known"), F.sum(logs).alias("logs"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    both = scored.select("*", none("bigint").alias("rare_known"), none("double").alias("rare_logs")).unionByName(
        rare.select(
            "doc_id", "text_key", none("boolean").alias("held_out"), none("bigint").alias("n_tokens"), none("bigint").alias("known"),
            none("double").alias("base_logs"), none("double").alias("class_logs"), F.col("known").alias("rare_known"),
            F.col("logs").alias("rare_logs"),
        )
    )
    one = both.groupBy("doc_id", "text_key").agg(
        F.count("n_tokens").alias("rows"), *(F.max(c).alias(c) for c in ("held_out", "n_tokens", "known", "base_logs", "class_logs")), F.coalesce(F.sum("rare_known"), F.lit(0)).alias("rare_known"), F.coalesce(F.sum("rare_logs"), F.lit(0.0)).alias("rare_logs")
    )
    each = one.withColumn(
        "row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))),
    )  # equal rows have brought their rare words once each
    return each.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.expr("rare_known div rows")).alias("n_known"),
        F.lit(known.total).cast("bigint").alias("train_tokens"),
        (F.col("base_logs") + F.col("rare_logs") / F.col("rows") - F.col("n_tokens") * known.base).alias("base_score"),
        (F.col("class_logs") + F.col("rare_logs") / F.col("rows")).alias("score"),
    )
