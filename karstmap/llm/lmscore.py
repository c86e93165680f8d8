"""A hidden Markov language model, trained by Baum-Welch over all training texts, and a unigram base.

Counts of all training tokens are summed in the shuffle; nothing is left out of them. At most ``HEAD_WORDS`` words, the
commonest of 4 occurrences or more, are symbols of their own. Every other word, met in training or not, is told by its last bytes as one of ``ENDINGS``
symbols, and within its symbol by its own exact count, which comes from a join on the word. So a text's probability is exact: that of
its symbols, by the scaled forward recursion over the latent states, times that of each word within its ending. What the
driver and the tasks hold has a fixed bound, whatever the corpus; the counts, which grow with it, stay a table. A word that
isn't among the commonest occurs seldom, so the join has no hot key but a word that training never saw.

Texts are coded once and stored. A round of Baum-Welch runs forward and backward over many texts at
a time, sums the expected counts in each task and sends those that aren't nothing, by blocks of the vocabulary, to be summed in two
steps, so no task gets more than a share of them; each round's shuffle is dropped before the next. Texts
of over ``CHUNK`` tokens are worked on in chunks, in training and in scoring, without being cut: each
chunk runs once from every state, which gives its transfer matrix, and the matrices, multiplied in order from both ends,
give the exact state probabilities at every border.

The rounds start from a model fitted to at most ``SAMPLE_DOCS`` training texts; it only breaks the
symmetry of the states, as each full round takes its expected counts from the whole corpus.

Defined results: null and empty texts are the end token alone; very long texts are read whole, in memory that grows with their ids alone; without training texts all
probabilities are those of an empty count; rows with a null id are scored, not learned from and not
held out; repeated rows give repeated rows; words of equal counts are ordered by their bytes; other columns are ignored.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from karstmap.llm.common import fold_of, slices, stored

STATES, ROUNDS, SAMPLE_ROUNDS, SAMPLE_DOCS = 8, 4, 25, 300
HEAD_WORDS, ENDINGS, ENDING_BYTES = 200_000, 4096, 3
BLOCK_WORDS, CHUNK, BATCH_TOKENS, FLUSH, SLICE = 8_192, 4096, 500_000, 250_000, 1000
RARE_LEVEL = 2  #: words of under 4 occurrences are always told by their endings, which so have the weight that new words need
END = 0  #: the first symbol; the endings and then the head words follow
FIRST_HEAD = ENDINGS + 1
PRIOR = 0.05  #: share of the unigram distribution mixed into each state's


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's words begin and the last one's end, and all words in a row, with A-Z in lower case; the end tokens are left to the caller."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    flat = split.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at an end splits off an empty word
    at = np.concatenate([[0], np.cumsum(np.asarray(some), dtype=np.int64)])
    offsets = np.asarray(split.offsets)
    return at[offsets - offsets[0]], flat.filter(some).dictionary_encode()


def ending(word: bytes) -> int:
    """The symbol of a word that isn't among the commonest."""
    return 1 + zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


def ending_of(word: str) -> Column:
    """ending() of a binary column."""
    tail = F.when(F.octet_length(word) <= ENDING_BYTES, F.col(word)).otherwise(F.substring(word, -ENDING_BYTES, ENDING_BYTES))
    return (1 + F.crc32(tail) % ENDINGS).cast("int")


def counted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n over all texts; the empty word counts the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in slices(batches, SLICE):
            _, own = words_of(batch.column(text_col))
            times = np.bincount(np.asarray(own.indices), minlength=len(own.dictionary))
            words = pa.concat_arrays([own.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())])
            held.append(pa.table({"word": words, "n": pa.array(np.append(times, batch.num_rows), pa.int64())}))
            if sum(map(len, held)) > 2 * FLUSH:
                held[:] = [summed()]
                if len(held[0]) > FLUSH:
                    yield from held.pop().combine_chunks().to_batches()
        if held:
            yield from summed().combine_chunks().to_batches()

    return df.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Steps:
    """Sequences stepped through side by side: longest first, and their tokens step by step."""

    def __init__(self, coded: list[np.ndarray]):
        lengths = np.array([len(x) for x in coded], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        n = int(lengths.max(initial=0))
        self.active = np.searchsorted(-self.lengths, -np.arange(n), side="left")  # sequences longer than each step
        self.begins = np.concatenate([[0], np.cumsum(self.active)])
        own = np.repeat(np.arange(len(coded)), self.lengths)
        step = np.arange(len(own)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.owner, self.symbols = np.empty(len(own), np.int32), np.empty(len(own), np.int32)
        at = self.begins[step] + own
        self.owner[at] = own
        self.symbols[at] = np.concatenate([coded[i] for i in self.order]) if coded else 0
        self.last = self.begins[self.lengths - 1] + np.arange(len(coded))


def portions(sequences: list[np.ndarray], most: int) -> Iterator[list[int]]:
    """Places of the sequences in runs of about most tokens."""
    own: list[int] = []
    held = 0
    for i, x in enumerate(sequences):
        own.append(i)
        held += len(x)
        if held >= most:
            yield own
            own, held = [], 0
    if own:
        yield own


class Model:
    """start (K), move (K x K) and emit (V x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def forward(self, s: Steps, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled state probabilities and scales of all tokens of s, and their emissions; before: state probabilities ahead of each sequence's first token."""
        emitted = self.emit[s.symbols]
        a, scale = np.empty_like(emitted), np.empty(len(emitted), emitted.dtype)
        ones, begins = np.ones(emitted.shape[1], emitted.dtype), s.begins.tolist()
        for t, live in enumerate(s.active.tolist()):
            own = a[begins[t] : begins[t + 1]]
            if t:
                np.dot(a[begins[t - 1] : begins[t - 1] + live], self.move, out=own)
            else:
                own[:] = before[s.order]
            own *= emitted[begins[t] : begins[t + 1]]
            total = own.dot(ones)
            own /= total[:, None]
            scale[begins[t] : begins[t + 1]] = total
        return a, scale, emitted

    def transfers(self, chunks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk the states at its end from each state ahead of its first move, rows that sum to 1, and the log of what they were scaled by."""
        k = len(self.start)
        matrix, logs = np.zeros((len(chunks), k, k)), np.zeros((len(chunks), k))
        for some in portions(chunks, BATCH_TOKENS // k):
            s = Steps([chunks[i] for i in some for _ in range(k)])
            a, scale, _ = self.forward(s, np.tile(self.move, (len(some), 1)))
            ends, sums = np.empty((len(s.order), k)), np.empty(len(s.order))
            ends[s.order] = a[s.last]
            sums[s.order] = np.bincount(s.owner, np.log(scale.astype(float)), len(s.order))
            matrix[some], logs[some] = ends.reshape(len(some), k, k), sums.reshape(len(some), k)
        return matrix, logs

    def borders(self, coded: list[np.ndarray], chunk: int = CHUNK) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All sequences in chunks: these, whose they are, the states at the end of the chunk before, the backward weights at each one's end, and the log likelihood of the later chunks of each sequence given the first."""
        k = len(self.start)
        pieces = [(i, x[c : c + chunk]) for i, x in enumerate(coded) for c in range(0, len(x), chunk)]
        owner = np.array([i for i, _ in pieces], np.int64)
        before, after, more = np.zeros((len(pieces), k)), np.ones((len(pieces), k)), np.zeros(len(coded))
        later = np.flatnonzero(np.diff(owner, prepend=-1) == 0)
        if len(later):
            place = np.full(len(pieces), -1)
            place[later] = np.arange(len(later))
            matrix, logs = self.transfers([pieces[i][1] for i in later])
            heads = np.setdiff1d(later - 1, later)
            state = np.zeros((len(pieces), k))
            for some in portions([pieces[i][1] for i in heads], BATCH_TOKENS):
                s = Steps([pieces[heads[i]][1] for i in some])
                a, _, _ = self.forward(s, np.tile(self.start, (len(some), 1)))
                ends = np.empty((len(some), k))
                ends[s.order] = a[s.last]
                state[heads[some]] = ends
            for i in later.tolist():
                own, top = logs[place[i]], logs[place[i]].max()
                before[i] = state[i - 1]
                state[i] = (state[i - 1] * np.exp(own - top)) @ matrix[place[i]]
                total = state[i].sum()
                state[i] /= total
                more[owner[i]] += top + np.log(total)
            for i in later[::-1].tolist():
                weight = np.exp(logs[place[i]] - logs[place[i]].max()) * (matrix[place[i]] @ after[i])
                after[i - 1] = weight / weight.max()
        return [x for _, x in pieces], owner, before, after, more

    def ahead(self, before: np.ndarray, is_start: np.ndarray) -> np.ndarray:
        """State probabilities ahead of the first tokens of chunks."""
        return np.where(is_start[:, None], self.start, before @ self.move)

    def expected(self, coded: list[np.ndarray], chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of first states, moves and (symbol, state) pairs, the last as V x K; sequences mustn't be empty."""
        k, kind = len(self.start), self.emit.dtype
        pieces, owner, before, after, _ = self.borders(coded, chunk)
        is_start = np.diff(owner, prepend=-1) > 0
        first, moves, counts = np.zeros(k), np.zeros((k, k)), np.zeros(self.emit.shape)
        ones = np.ones(k, kind)
        for some in portions(pieces, BATCH_TOKENS):
            s = Steps([pieces[i] for i in some])
            a, scale, emitted = self.forward(s, self.ahead(before[some], is_start[some]))
            emitted /= scale[:, None]
            b = np.ones_like(a)
            ends = after[some][s.order].astype(kind)
            b[s.last] = ends / np.einsum("ij,ij->i", a[s.last], ends)[:, None]
            begins = s.begins.tolist()
            for t in range(len(s.active) - 1, 0, -1):
                live = begins[t + 1] - begins[t]
                own = emitted[begins[t] : begins[t + 1]]
                own *= b[begins[t] : begins[t + 1]]
                np.dot(own, self.move.T, out=b[begins[t - 1] : begins[t - 1] + live])
            later = np.arange(begins[1], begins[-1])
            if len(later):  # a token's place at the step before
                step = np.repeat(np.arange(1, len(s.active)), s.active[1:])
                moves += (a[later - s.begins[step] + s.begins[step - 1]].T @ emitted[later]).astype(float)
            gamma = a
            gamma *= b
            gamma /= gamma.dot(ones)[:, None]
            for i in range(k):
                counts[:, i] += np.bincount(s.symbols, gamma[:, i], len(self.emit))
            own = is_start[some][s.order]
            first += gamma[: begins[1]][own].sum(axis=0)
            moves += (before[some][s.order][~own].T @ (emitted[: begins[1]] * b[: begins[1]])[~own]).astype(float)
        return first, moves * self.move, counts

    def logp(self, coded: list[np.ndarray], chunk: int = CHUNK) -> np.ndarray:
        """Natural log likelihood of each sequence, however long."""
        pieces, owner, _, _, out = self.borders(coded, chunk)
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        for some in portions([pieces[i] for i in heads], BATCH_TOKENS):
            s = Steps([pieces[heads[i]] for i in some])
            _, scale, _ = self.forward(s, np.tile(self.start, (len(some), 1)))
            sums = np.empty(len(some))
            sums[s.order] = np.bincount(s.owner, np.log(scale), len(some))
            out[owner[heads[some]]] += sums
        return out


def fitted(first: np.ndarray, moves: np.ndarray, emitted: np.ndarray, unigram: np.ndarray) -> Model:
    """The model that expected counts give, smoothed so that nothing is impossible."""
    share = emitted / np.maximum(emitted.sum(axis=0, dtype=float), 1e-300)
    return Model((first + 1) / (first + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), (1 - PRIOR) * share + PRIOR * unigram[:, None] if emitted.sum() else np.tile(unigram[:, None], (1, len(first))))


def seeded(coded: list[np.ndarray], unigram: np.ndarray, states: int) -> Model:
    """A model fitted to a few texts on the driver, from states spread by a fixed draw and slow moves between them."""
    draw = np.random.default_rng(0)
    emitted = unigram[:, None] * draw.uniform(0.2, 1.8, (len(unigram), states))
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.01 / states) + 0.99 * np.eye(states), emitted / emitted.sum(axis=0))
    if not coded:
        return model
    met = np.unique(np.concatenate(coded))
    model.emit = model.emit[met]
    coded = [np.searchsorted(met, x) for x in coded]
    for _ in range(SAMPLE_ROUNDS):
        model = fitted(*model.expected(coded), unigram[met])
    emit = np.tile(PRIOR * unigram[:, None], (1, states))  # as fitted() gives symbols that don't occur
    emit[met] = model.emit
    return Model(model.start, model.move, emit)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows gathered until they hold BATCH_TOKENS tokens."""
    rows: list[dict] = []
    held = 0
    for batch in slices(batches):
        for row in batch.to_pylist():
            row["ids"] = np.frombuffer(row["ids"], np.int32)
            rows.append(row)
            held += len(row["ids"])
            if held > BATCH_TOKENS:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _sparse(counts: np.ndarray, block: int, part: int) -> tuple[int, int, bytes, bytes]:
    """block, part, the rows that hold counts and these as 32-bit numbers."""
    at = np.flatnonzero(counts.any(axis=1)).astype(np.int32)
    return block, part, at.tobytes(), counts[at].astype(np.float32).tobytes()


def _batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["block", "part", "at", "counts"])


def _added(df: DataFrame, by: tuple[str, ...], size: int, states: int) -> DataFrame:
    """block and the sum of its arrays, streamed through one task for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, at, values in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "at", "counts")), strict=True):
                key = (block, part if "part" in by else 0)
                if key not in total:
                    total[key] = np.zeros((states + 1 if block < 0 else BLOCK_WORDS, states))
                total[key][np.frombuffer(at, np.int32)] += np.frombuffer(values, np.float32).reshape(-1, states)
        for (block, part), values in total.items():
            yield _batch([_sparse(values, block, part)])

    return df.repartition(size, *by).mapInArrow(run, "block int, part int, at binary, counts binary")


class Trained:
    """What a training set gives: all counts (a table), how many tokens and distinct ones, the head words and, by symbol, occurrences and distinct words."""

    def __init__(self, counts: DataFrame, words: list[bytes], held: np.ndarray, distinct: np.ndarray):
        self.counts, self.words, self.held = counts, words, held
        self.total, self.distinct, self.symbols = int(held.sum()), int(distinct.sum()), len(held)
        within = np.log10(held[1:FIRST_HEAD] + 0.5 * (distinct[1:FIRST_HEAD] + 1))
        self.within = np.concatenate([[0.0], within, np.zeros(len(words))])  #: log10 of what shares of a word within its ending's symbol are of


def learned_counts(train: DataFrame, text_col: str = "text", head_words: int = HEAD_WORDS) -> Trained:
    """All counts, and the head: the words of the smallest power of two of occurrences, 4 or more, that at most head_words words reach."""
    counts = stored(counted(train, text_col), "counts")
    words = counts.where(F.length("word") > 0)
    level = F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int").alias("level")
    levels = {r["level"]: r["words"] for r in words.groupBy(level).agg(F.count("*").alias("words")).collect()}
    ends = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    least, reached = 64, 0
    while least > RARE_LEVEL and reached + levels.get(least - 1, 0) <= head_words:
        least -= 1
        reached += levels.get(least, 0)
    head = words.where(level >= least).orderBy(F.desc("n"), "word").toArrow()  # at most head_words rows
    held, distinct = np.zeros(FIRST_HEAD + len(head), np.int64), np.ones(FIRST_HEAD + len(head), np.int64)
    held[0], distinct[0], distinct[1:FIRST_HEAD] = ends, ends > 0, 0
    for r in words.where(level < least).groupBy(ending_of("word").alias("symbol")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # at most ENDINGS rows
        held[r["symbol"]], distinct[r["symbol"]] = r["n"], r["words"]
    if len(head):
        held[FIRST_HEAD:] = np.asarray(head.column("n"), np.int64)
    return Trained(counts, head.column("word").to_pylist() if len(head) else [], held, distinct)


def coded(df: DataFrame, words: list[bytes], id_col: str = "doc_id", text_col: str = "text", train_col: str = "train") -> DataFrame:
    """row (a number of its own), id_col, train_col, ids (symbols as 32-bit binary), rare (the distinct words that aren't head words) and times (how often each occurs)."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = pa.array(shared.value, pa.binary())
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, SLICE):
            ends, own = words_of(batch.column(text_col))
            names, at = own.dictionary.cast(pa.binary()), np.asarray(own.indices)
            symbol = FIRST_HEAD + np.asarray(pc.index_in(names, heads).fill_null(-FIRST_HEAD)).astype(np.int32)
            symbol[symbol < FIRST_HEAD] = [ending(w) for w in names.filter(pa.array(symbol < FIRST_HEAD)).to_pylist()]
            ids = np.insert(symbol[at], ends[1:], np.int32(END))
            sizes = np.diff(ends)
            other = symbol[at] < FIRST_HEAD
            pairs, times = np.unique(np.repeat(np.arange(batch.num_rows), sizes)[other] * max(1, len(names)) + at[other], return_counts=True)
            whose, which = np.divmod(pairs, max(1, len(names)))
            lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=batch.num_rows))]), pa.int32())
            coded_ids = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.array(4 * (ends + np.arange(len(ends))), pa.int32()).buffers()[1], pa.py_buffer(ids.astype(np.int32).tobytes())])
            rare, times = pa.ListArray.from_arrays(lists, names.take(pa.array(which))), pa.ListArray.from_arrays(lists, pa.array(times, pa.int32()))
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column(id_col), batch.column(train_col), coded_ids, rare, times], ["row", id_col, train_col, "ids", "rare", "times"])

    return df.select(id_col, text_col, train_col).mapInArrow(run, f"row long, `{id_col}` {kind}, `{train_col}` boolean, ids binary, rare array<binary>, times array<int>")


def baum_welch(rows: DataFrame, trained: Trained, train_col: str = "train", states: int = STATES, rounds: int = ROUNDS) -> Model:
    """rounds of expected counts over all training rows, each summed over the partitions by blocks of the vocabulary."""
    spark = rows.sparkSession
    unigram = (trained.held + 0.5) / (trained.held + 0.5).sum()
    train = rows.where(F.col(train_col))
    few = train.select("row").orderBy(F.xxhash64("row"), "row").limit(SAMPLE_DOCS)
    sample = train.join(F.broadcast(few), "row").select("ids").toArrow()  # at most SAMPLE_DOCS rows
    size = trained.symbols
    model = seeded([np.frombuffer(x, np.int32) for x in sample.column("ids").to_pylist()], unigram, states)
    blocks = -(-size // BLOCK_WORDS)
    spread = max(1, round(train.rdd.getNumPartitions() ** 0.5))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast([x.astype(np.float32) for x in (model.start, model.move, model.emit)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Model(*shared.value)
            k = len(own.start)
            edge, emitted = np.zeros((k + 1, k)), np.zeros((size, k))
            for part in batches_of(batches):
                first, moves, counts = own.expected([r["ids"] for r in part])
                edge[0] += first
                edge[1:] += moves
                emitted += counts
            if edge.any():
                part = TaskContext.get().partitionId() % spread
                yield _batch([_sparse(edge, -1, part), *(_sparse(emitted[b * BLOCK_WORDS : (b + 1) * BLOCK_WORDS], b, part) for b in range(blocks))])

        sent = train.select("ids").mapInArrow(run, "block int, part int, at binary, counts binary")
        wide = min(64, (blocks + 1) * spread)
        edge, emitted = np.zeros((states + 1, states)), np.zeros((size, states), np.float32)
        summed = _added(_added(sent, ("block", "part"), wide, states), ("block",), min(64, blocks + 1), states)
        for r in summed.collect():  # symbols x states numbers
            to = edge if r["block"] < 0 else emitted[r["block"] * BLOCK_WORDS : (r["block"] + 1) * BLOCK_WORDS]
            to[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["counts"], np.float32).reshape(-1, states)
        if edge.any():
            model = fitted(edge[0], edge[1:], emitted, unigram)
        del sent, summed
        shared.destroy()
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # so that Spark's cleaner drops the round's shuffles from disk
    return model


def scored(rows: DataFrame, trained: Trained, model: Model, id_col: str = "doc_id", train_col: str = "train") -> DataFrame:
    """id_col, train_col, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = rows.sparkSession
    kind, id_type = rows.schema[id_col].dataType.simpleString(), to_arrow_type(rows.schema[id_col].dataType)
    own_word = np.arange(trained.symbols) >= FIRST_HEAD
    own_word[END] = True
    logs = np.where(own_word, np.log10(trained.held + 0.5), 0.0)
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit.astype(np.float32), logs, own_word & (trained.held > 0), trained.within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, logs, known, within = shared.value
        own = Model(start, move, emit.astype(float))
        for part in batches_of(batches):
            ids = [r["ids"] for r in part]
            hmm = own.logp(ids) / np.log(10) - np.array([within[x].sum() for x in ids])
            columns = [pa.array([r["row"] for r in part], pa.int64()), pa.array([r[id_col] for r in part], id_type), pa.array([r[train_col] for r in part], pa.bool_())]
            columns += [pa.array([f(x) for x in ids], t) for f, t in ((len, pa.int64()), (lambda x: int(known[x].sum()), pa.int64()), (lambda x: float(logs[x].sum()), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hmm, pa.float64())], ["row", id_col, train_col, "n_tokens", "known", "head_log", "hmm"])

    own = rows.select("row", id_col, train_col, "ids").mapInArrow(run, f"row long, `{id_col}` {kind}, `{train_col}` boolean, n_tokens long, known long, head_log double, hmm double")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    met = rare.join(trained.counts.where(F.length("word") > 0), "word", "left")
    sums = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    all_log = float(np.log10(trained.total + 0.5 * (trained.distinct + 1)))
    of_rare = F.coalesce("rare_log", F.lit(0.0))
    return own.join(sums, "row", "left").select(
        id_col,
        train_col,
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(trained.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + of_rare - F.col("n_tokens") * all_log).alias("base_score"),
        (F.col("hmm") + of_rare).alias("score"),
    )


def language_model_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, states: int = STATES, rounds: int = ROUNDS, head_words: int = HEAD_WORDS) -> DataFrame:
    """scored() of every text, learning from those outside the held fold."""
    train = F.coalesce(fold_of(id_col, folds) != held, F.lit(False))
    docs = df.select(F.col(id_col), F.col(text_col), train.alias("__train"))
    trained = learned_counts(docs.where("__train"), text_col, head_words)
    rows = stored(coded(docs, trained.words, id_col, text_col, "__train"), "coded")
    model = baum_welch(rows, trained, "__train", states, rounds)
    return scored(rows, trained, model, id_col, "__train")
