"""A hidden Markov language model over whole texts.

Tokens are the words of a text, A-Z lower-cased, and one end. The model's symbols are the most frequent words of the training
texts, a class for each shape of all other words, and the end. A word of a class is emitted as its class, then as a word of
the class with its smoothed share of the class's training tokens, (c + 0.1) / (n + 0.1 * (v + 1)), times what the state
makes of it. So each text has an exact probability: the scaled forward recursion's.

Texts are turned into numbers once, and all that follows reads these. Baum-Welch runs over all training texts: each task adds up
its expected counts and Spark sums them by symbol. In the last round expected counts of every other training word go into a
table of words and states, however many words there are and however seldom they are seen: a state's share of a word's tokens,
against its share of all such words' of the class, is what the state makes of that word. SHRINK of it is taken from the class.
A word that training texts don't hold has the share of one unseen word, as in the base score, in every state.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import binary_texts, held_out, in_slices, materialise, whole
from fathom.llm.wordhash import Words, words

STATES, ROUNDS, SYMBOLS, FREQUENT = 6, 3, 16_384, 262_144
LENGTHS, SHAPES = 16, 3
CLASSES = LENGTHS * SHAPES
ALPHA = 0.1
SLICE_BYTES = 4 << 20  # the fewer the slices, the more texts step together
HELD_WORDS = 600_000
HELD_EXPECTED = 200_000
SHRINK = 0.3
SEGMENT = 1 << 16
PARTS = 256  # of a token: how finely a rare word's tokens are told apart by state, so that sums are exact


def word_class(found: Words) -> np.ndarray:
    """A word's class: its length in bytes, up to 16, and whether it has ASCII letters only, other letters, or marks and digits."""
    buf = found.buf
    marks = np.cumsum(np.concatenate([[0], (buf < 97) | ((buf > 122) & (buf < 128))]))
    wide = np.cumsum(np.concatenate([[0], buf >= 128]))
    shape = np.where(marks[found.end] > marks[found.start], 2, wide[found.end] > wide[found.start])
    return (np.minimum(found.end - found.start, LENGTHS) - 1) * SHAPES + shape


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, n) of all words of docs: word is a 64-bit hash. Counts are added up in each task, then by Spark."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def merged():
            h, c, n = (np.concatenate(x) for x in zip(*held))
            h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return h, c[first], np.bincount(inverse, n, len(h)).astype(np.int64)

        def batch_of(h, c, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], ["word", "class", "n"])

        size = 0
        for batch in batches:
            found = binary_texts(batch.column("text"))
            for a, b in in_slices(found, SLICE_BYTES):
                w = words(found[a:b])
                h, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((h, word_class(w)[first], n))
                size += len(h)
                if size > HELD_WORDS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD_WORDS // 2:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merged())

    return docs.select("text").mapInArrow(run, "word long, class int, n long").groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


class Lexicon:
    """What all tasks know: the `frequent` commonest words with their counts and classes, of which the first `symbols` are
    symbols of their own, and totals by class. Its size has a fixed bound; all other words stay in tables."""

    def __init__(self, frequent: list, symbols: int, classes: list, texts: int, total: int, distinct: int):
        h = np.array([r[0] for r in frequent], np.int64).view(np.uint64)
        self.order = np.argsort(h)
        self.hashes, self.counts, self.kinds = h[self.order], np.array([r[1] for r in frequent], np.int64)[self.order], np.array([r[2] for r in frequent], np.int64)[self.order]
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for c, n, v in classes:
            self.class_n[c], self.class_v[c] = n, v
        self.symbols = min(symbols, len(h))
        self.end = self.symbols + CLASSES
        self.texts, self.total, self.distinct = texts, total, distinct

    def codes(self, found: Words) -> np.ndarray:
        """Each word as one number: a symbol; end + 1 + its place among the hashes, if it is frequent but none; else -1 - its class."""
        at = np.minimum(np.searchsorted(self.hashes, found.hash), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == found.hash if len(self.hashes) else np.zeros(len(found.hash), bool)
        rank = self.order[at] if len(self.hashes) else at
        return np.where(known, np.where(rank < self.symbols, rank, self.end + 1 + at), -1 - word_class(found)).astype(np.int32)

    def symbols_of(self, code: np.ndarray) -> np.ndarray:
        """The symbols of codes: frequent words that are none, and rarer ones, are their class."""
        out = np.where(code >= 0, code, self.symbols - 1 - code)
        frequent = code > self.end
        out[frequent] = self.symbols + self.kinds[code[frequent] - self.end - 1]
        return out

    def base(self, counts) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))

    def share(self, counts, kind) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.class_n[kind] + ALPHA * (self.class_v[kind] + 1)))


def lexicon(counts: DataFrame, texts: int, symbols: int = SYMBOLS, frequent: int = FREQUENT) -> Lexicon:
    """From the counts of all words: at most `frequent` rows and one a class come to the driver."""
    rows = counts.orderBy(F.desc("n"), "word").limit(frequent).select("word", "n", "class").toArrow()
    rows = list(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), rows["class"].to_pylist()))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    classes = {r["class"]: [r["class"], r["n"], r["v"]] for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    for _, n, kind in rows[:symbols]:  # symbols of their own are in no class
        classes[kind][1] -= n
        classes[kind][2] -= 1
    return Lexicon(rows, symbols, list(classes.values()), texts, total + texts, distinct + (texts > 0))


class Model:
    """start, transition and emission probabilities. Rows of emission are symbols."""

    def __init__(self, start: np.ndarray, transition: np.ndarray, emission: np.ndarray):
        self.start, self.transition, self.emission = start, transition, emission

    @staticmethod
    def first(lexicon: Lexicon, states: int, seed: int) -> "Model":
        """Unigram emissions, shaken so that states can part, and states that last, so that they part by what goes together."""
        rng = np.random.default_rng(seed)
        n = np.zeros(lexicon.end + 1)
        rank_counts = np.zeros(len(lexicon.counts))
        rank_counts[lexicon.order] = lexicon.counts
        n[: lexicon.symbols] = rank_counts[: lexicon.symbols]
        n[lexicon.symbols : lexicon.end], n[lexicon.end] = lexicon.class_n, lexicon.texts
        return Model.of(np.ones(states), rng.uniform(1, 2, (states, states)) + 50 * states * np.eye(states), (n[:, None] + ALPHA) * rng.uniform(0.5, 1.5, (len(n), states)))

    @staticmethod
    def of(start: np.ndarray, transition: np.ndarray, emission: np.ndarray) -> "Model":
        return Model(start / start.sum(), transition / transition.sum(1, keepdims=True), emission / emission.sum(0))

    def forward_backward(self, symbols: list[np.ndarray], counts: tuple | None = None, seen=None, emission: np.ndarray | None = None) -> np.ndarray:
        """The log10 probability of each symbol sequence (none is empty); with counts, (start, transition, emission), the
        expected counts are added to them. seen(which, gamma) gets each sequence's state probabilities, by parts: which is
        (sequences, places). emission: rows for symbols, if they are others than the model's.

        Sequences of up to SEGMENT symbols step together, the long ones last; longer ones go alone, a segment at a time.
        """
        emission = self.emission if emission is None else emission
        out = np.empty(len(symbols))
        short = [k for k, s in enumerate(symbols) if len(s) <= SEGMENT]
        if short:
            out[short] = self._together([symbols[k] for k in short], np.array(short), counts, seen, emission)
        for k, s in enumerate(symbols):
            if len(s) > SEGMENT:
                out[k] = self._alone(s, k, counts, seen, emission)
        return out

    def _together(self, symbols, numbers, counts, seen, emission) -> np.ndarray:
        lengths = np.array([len(s) for s in symbols])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        steps, states = int(lengths[0]), len(self.start)
        alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t are the first alive[t]
        offsets = np.concatenate([[0], np.cumsum(alive)])
        flat = np.empty(offsets[-1], np.int64)  # step by step: symbol t of all sequences that have one
        for i, k in enumerate(order):
            flat[offsets[: lengths[i]] + i] = symbols[k]
        emitted = emission[flat]
        alpha, scale = np.empty((len(flat), states)), np.empty(len(flat))
        a = self.start * emitted[: alive[0]]
        for t in range(steps):
            if t:
                a = a[: alive[t]] @ self.transition
                a *= emitted[offsets[t] : offsets[t + 1]]
            c = a.sum(1)
            a /= c[:, None]
            alpha[offsets[t] : offsets[t + 1]], scale[offsets[t] : offsets[t + 1]] = a, c
        owner = np.concatenate([np.arange(n) for n in alive])
        out = np.empty(len(symbols))
        out[order] = np.bincount(owner, np.log10(scale), len(symbols))
        if counts is not None:
            gamma = self._backward(alpha, scale, emitted, flat, alive, offsets, counts)
            if seen:
                seen((numbers[order][owner], np.repeat(np.arange(steps), alive)), gamma)
        return out

    def _backward(self, alpha, scale, emitted, flat, alive, offsets, counts) -> np.ndarray:
        start, transition, emission = counts
        steps, states = len(alive), len(self.start)
        beta = np.ones((alive[-1], states))
        back = self.transition.T.copy()
        for t in range(steps - 1, -1, -1):
            at = slice(offsets[t], offsets[t + 1])
            gamma = alpha[at] * beta
            if t:
                u = emitted[at] * beta
                u /= scale[at, None]
                transition += self.transition * (alpha[offsets[t - 1] : offsets[t - 1] + alive[t]].T @ u)
                grown = np.ones((alive[t - 1], states))
                grown[: alive[t]] = u @ back
                beta = grown
            alpha[at] = gamma  # alpha isn't needed any more
        start += alpha[: alive[0]].sum(0)
        for k in range(states):
            emission[:, k] += np.bincount(flat, alpha[:, k], len(emission))
        return alpha

    def _alone(self, symbols: np.ndarray, number: int, counts, seen, emission) -> float:
        """One sequence: only what each segment begins with is kept, and a segment's steps are made again on the way back."""
        cuts = [*range(0, len(symbols), SEGMENT), len(symbols)]
        begins, logs = [self.start], 0.0  # begins: the state probabilities before each segment's first symbol
        for a, b in zip(cuts, cuts[1:]):
            alpha, scale = self._segment(begins[-1], emission[symbols[a:b]])
            begins.append(alpha[-1] @ self.transition)
            logs += float(np.log10(scale).sum())
        if counts is None:
            return logs
        beta = np.ones(len(self.start))
        for i in range(len(cuts) - 2, -1, -1):
            a, b = cuts[i], cuts[i + 1]
            emitted = emission[symbols[a:b]]
            alpha, scale = self._segment(begins[i], emitted)
            gamma = np.empty_like(alpha)
            u = np.empty_like(alpha)
            for t in range(b - a - 1, -1, -1):
                gamma[t] = alpha[t] * beta
                u[t] = emitted[t] * beta / scale[t]
                beta = self.transition @ u[t]
            counts[1][:] += self.transition * (alpha[:-1].T @ u[1:])
            if i:  # from the last symbol of the segment before: begins[i] is its alpha times the transitions
                last = self._segment(begins[i - 1], emission[symbols[cuts[i - 1] : a]])[0][-1]
                counts[1][:] += self.transition * np.outer(last, u[0])
            else:
                counts[0][:] += gamma[0]
            for k in range(len(self.start)):
                counts[2][:, k] += np.bincount(symbols[a:b], gamma[:, k], len(counts[2]))
            if seen:
                seen((np.full(b - a, number), np.arange(a, b)), gamma)
        return logs

    def _segment(self, before: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha, scale = np.empty_like(emitted), np.empty(len(emitted))
        for t in range(len(emitted)):
            a = before * emitted[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
            before = alpha[t] @ self.transition
        return alpha, scale


def coded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(row, doc_id, held_out, codes, hashes): each text's codes and its end's, and the hashes of its rare words in their order."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        lex = shared.value
        row = TaskContext.get().partitionId() << 40
        offsets = lambda bounds: pa.array(bounds.astype(np.int32))
        for batch in batches:
            found = binary_texts(batch.column("text"))
            for a, b in in_slices(found, SLICE_BYTES):
                w = words(found[a:b])
                code = lex.codes(w)
                rare = code < 0
                codes = pa.ListArray.from_arrays(offsets(w.bounds + np.arange(b - a + 1)), pa.array(np.insert(code, w.bounds[1:], lex.end)))
                hashes = pa.ListArray.from_arrays(offsets(np.concatenate([[0], np.cumsum(rare)])[w.bounds]), pa.array(w.hash[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(b - a)), batch.column("doc_id")[a:b], batch.column("held_out")[a:b], codes, hashes], ["row", "doc_id", "held_out", "codes", "hashes"])
                row += b - a

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, codes array<int>, hashes array<long>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts and where each text's begin and end."""
    lists = batch.column("codes")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy().astype(np.int64), bounds - bounds[0]


def in_parts(gamma: np.ndarray) -> np.ndarray:
    """State probabilities in whole PARTS, which make one token together."""
    upto = np.rint(np.cumsum(gamma, axis=1) * PARTS)
    upto[:, -1] = PARTS
    return np.diff(upto, axis=1, prepend=0) / PARTS


class Expected:
    """Expected tokens by state of one task's words: frequent ones by place, others by hash."""

    def __init__(self, lex: Lexicon, states: int):
        self.lex, self.frequent = lex, np.zeros((len(lex.hashes), states))
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, code: np.ndarray, hashes: np.ndarray, rare_at: np.ndarray, at: np.ndarray, gamma: np.ndarray) -> None:
        """gamma: state probabilities of the tokens at `at`; rare_at: for each token, how many before it are rare."""
        c = code[at]
        often, rare = c > self.lex.end, c < 0
        place = c[often] - self.lex.end - 1
        for k in range(gamma.shape[1]):
            self.frequent[:, k] += np.bincount(place, gamma[often, k], len(self.frequent))
        self.held.append((hashes[rare_at[at[rare]]], -1 - c[rare], in_parts(gamma[rare])))
        self.size += int(rare.sum())

    def taken(self, least: int = 0):
        """The sums by hash, which go, if least words or more are held: (hashes, classes, tokens by state)."""
        if self.size <= 2 * least or not self.held:
            return None
        h, c, g = (np.concatenate(x) for x in zip(*self.held))
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        found = h, c[first], np.stack([np.bincount(inverse, g[:, k], len(h)) for k in range(g.shape[1])], axis=1)
        self.held, self.size = ([], 0) if len(h) > least else ([found], len(h))
        return found if not self.held else None


def trained(rows: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS, seed: int = 3) -> tuple[Model, np.ndarray, DataFrame]:
    """Baum-Welch over rows (codes, hashes): the model; tokens by state of the frequent words; and a table of all other words,
    (word, class, s0, s1, ...), with theirs. Each task sends a row a symbol and, in the last round, a row a word; Spark sums
    them."""
    model = Model.first(lex, states, seed)
    context = rows.sparkSession.sparkContext
    names = [f"s{k}" for k in range(states)]
    schema = ", ".join(["row int, word long", *(f"{k} double" for k in names)])
    n, kept, frequent = lex.end + 1, None, np.zeros((len(lex.hashes), states))
    for number in range(rounds if lex.texts else 0):
        last = number == rounds - 1
        shared = context.broadcast((lex, model))

        def run(batches, last=last, shared=shared):
            lex, model = shared.value
            counts = np.zeros(states), np.zeros((states, states)), np.zeros(model.emission.shape)
            expected = Expected(lex, states)

            def rows_of(row, word, g):
                return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), word, *(pa.array(g[:, k]) for k in range(states))], ["row", "word", *names])

            for batch in batches:
                code, bounds = _flat(batch)
                if not len(code):
                    continue
                hashes, rare_at = batch.column("hashes").flatten().to_numpy(), np.cumsum(code < 0) - (code < 0)

                def seen(which, gamma, code=code, bounds=bounds, hashes=hashes, rare_at=rare_at):
                    expected.add(code, hashes, rare_at, bounds[which[0]] + which[1], gamma)

                model.forward_backward(np.split(lex.symbols_of(code), bounds[1:-1]), counts, seen if last else None)
                if found := expected.taken(HELD_EXPECTED):
                    yield rows_of(-1 - found[1], pa.array(found[0]), found[2])
            if found := expected.taken():
                yield rows_of(-1 - found[1], pa.array(found[0]), found[2])
            sums = np.concatenate([counts[2], counts[1], counts[0][None], *([expected.frequent] if last else [])])
            used = np.flatnonzero(sums.any(1))
            yield rows_of(used, pa.nulls(len(used), pa.int64()), sums[used])

        sums = rows.select("codes", "hashes").mapInArrow(run, schema).groupBy("row", "word").agg(*[F.sum(k).alias(k) for k in names])
        if last:
            sums = kept = materialise(sums, "expected")
        sums = sums.where("row >= 0").toArrow()  # a row a symbol, state and frequent word
        table = np.zeros((n + states + 1 + len(frequent), states))
        table[sums["row"].to_numpy()] = np.stack([sums[k].to_numpy() for k in names], axis=1)
        model = Model.of(table[n + states] + ALPHA, table[n : n + states] + ALPHA, table[:n] + ALPHA / 10)
        frequent = table[n + states + 1 :]
        shared.unpersist()
    if kept is None:
        kept = rows.sparkSession.createDataFrame([], schema)
    return model, frequent, kept.where("row < 0").select("word", (-1 - F.col("row")).alias("class"), *names)


def packed(names: list[str], n: Column) -> Column:
    """A word's shares by state as one long: whole parts of 2**bits - 1, which are one together."""
    bits = 60 // len(names)
    upto, before, out = F.lit(0.0), F.lit(0), F.lit(0)
    for k, name in enumerate(names):
        upto = upto + F.col(name)
        now = F.round(upto / n * F.lit((1 << bits) - 1)).cast("long")
        out = out + F.shiftleft(now - before, bits * k)
        before = now
    return out


def unpacked(p: np.ndarray, states: int) -> np.ndarray:
    bits = 60 // states
    return np.stack([(p >> (bits * k)) & ((1 << bits) - 1) for k in range(states)], axis=1) / ((1 << bits) - 1)


def sums_by_class(others: DataFrame, states: int) -> np.ndarray:
    """Tokens by class and state of all words of others (class, n, p)."""
    bits = 60 // states
    share = [(F.shiftright("p", bits * k).bitwiseAND(F.lit((1 << bits) - 1)) * F.col("n")).alias(f"s{k}") for k in range(states)]
    out = np.zeros((CLASSES, states))
    for r in others.select("class", *share).groupBy("class").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).collect():
        out[r["class"]] = [r[f"s{k}"] / ((1 << bits) - 1) for k in range(states)]
    return out


def leaning(expected: np.ndarray, n: np.ndarray, kind: np.ndarray, by_class: np.ndarray, shrink: float = SHRINK) -> np.ndarray:
    """What each state makes of words of the given classes: (words, states). expected: their tokens by state; n: in all; by_class:
    the same of all such words of a class. A class's words, times their shares, add up to one in each state."""
    usual = by_class / np.maximum(by_class.sum(1, keepdims=True), 1e-300)  # each state's share of a class's tokens
    usual = usual[kind]
    own = np.divide(expected, usual, out=np.repeat(n[:, None].astype(float), expected.shape[1], axis=1), where=usual > 1e-12)
    return ((1 - shrink) * own + shrink * n[:, None] + ALPHA) / (n[:, None] + ALPHA)


@whole
def score(docs: DataFrame, modulus: int = 10, remainder: int = 0, states: int = STATES, rounds: int = ROUNDS, symbols: int = SYMBOLS, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id) mod modulus isn't remainder. A null or empty text is the end token alone. A very
    long text is scored whole, its states a segment at a time. Repeated rows count and are scored each; an empty table gives
    no rows; other columns are not read. Where nothing is left to learn from, all tokens are unknown and the model is uniform.
    Sums of the same numbers in another order may differ in their last digits.
    """
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    training = docs.where("not held_out")
    counts = materialise(word_counts(training), "words")
    lex = lexicon(counts, training.select("doc_id").count(), symbols, frequent)
    rows = materialise(coded(docs, lex), "codes")
    model, tokens, expected = trained(rows.where("not held_out"), lex, states, rounds)
    n = sum((F.col(f"s{k}") for k in range(states)), F.lit(0.0))  # a word's parts make its tokens
    others = materialise(expected.select("word", "class", F.round(n).cast("long").alias("n"), packed([f"s{k}" for k in range(states)], n).alias("p")), "others")
    by_class = sums_by_class(others, states)
    none = np.zeros(len(lex.hashes), bool)
    none[lex.order < lex.symbols] = True
    np.add.at(by_class, lex.kinds[~none], tokens[~none])
    own = np.ones((len(lex.hashes), states))
    own[~none] = leaning(tokens[~none], lex.counts[~none], lex.kinds[~none], by_class) if lex.texts else 1
    emission = np.concatenate([model.emission, model.emission[lex.symbols + lex.kinds] * own])
    shared = docs.sparkSession.sparkContext.broadcast((lex, model, emission, by_class))

    def scored(batches):
        lex, model, emission, by_class = shared.value
        first_rare = len(emission)
        by_code = np.zeros(first_rare, np.int64)
        by_code[lex.order[lex.order < lex.symbols]] = lex.counts[lex.order < lex.symbols]
        by_code[lex.end], by_code[lex.end + 1 :] = lex.texts, lex.counts
        kind_of = np.concatenate([np.full(lex.end + 1, -1), lex.kinds])
        for batch in batches:
            code, bounds = _flat(batch)
            met = batch.column("found").flatten()
            word, at = np.unique(met.field("word").to_numpy(), return_index=True)
            n, p = met.field("n").to_numpy()[at].astype(np.int64), met.field("p").to_numpy()[at]
            rare = np.flatnonzero(code < 0)
            h = batch.column("hashes").flatten().to_numpy()
            place = np.minimum(np.searchsorted(word, h), max(0, len(word) - 1))
            there = word[place] == h if len(word) else np.zeros(len(h), bool)
            token_kind = np.where(code >= 0, kind_of[np.maximum(code, 0)], -1 - code)
            kind = np.zeros(len(word), np.int64)
            kind[place[there]] = token_kind[rare[there]]
            own = leaning(unpacked(p, states) * n[:, None], n, kind, by_class)
            every = np.concatenate([emission, model.emission[lex.symbols + kind] * own])
            code[rare] = np.where(there, first_rare + place, lex.symbols + token_kind[rare])
            count = np.concatenate([by_code, n])[code]
            sums = lambda x: np.add.reduceat(x, bounds[:-1])  # no document is without its end
            classed = token_kind >= 0
            share = np.zeros(len(code))
            share[classed] = lex.share(count[classed], token_kind[classed])
            scores = model.forward_backward(np.split(code, bounds[1:-1]), emission=every) + sums(share)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(bounds)), pa.array(sums((count > 0).astype(np.int64))), pa.array(sums(lex.base(count))), pa.array(scores)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    asked = rows.select("row", F.explode(F.array_distinct("hashes")).alias("word"))
    found = asked.join(others.select("word", "n", "p"), "word").groupBy("row").agg(F.collect_list(F.struct("word", "n", "p")).alias("found"))  # a document's words
    rows = rows.join(found, "row", "left").select("doc_id", "held_out", "codes", "hashes", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), "base_score", "score")
