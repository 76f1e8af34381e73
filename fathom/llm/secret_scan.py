"""Secret scan: fixed credential formats, and formats inferred from labelled credentials.

The fixed rules give the base spans. Their values on a bounded sample of documents are the labelled credentials of each
kind. For each kind the values' prefix tree is folded into a probabilistic automaton: two states merge where a Hoeffding
bound can't tell their futures apart, and enough strings came to both to tell. Runs of credential characters that no rule
marks train a background automaton the same way, without those that look like credentials themselves. A run is a secret
where a kind's automaton finds its characters and its end as likely as those of the labelled values of that kind, and
explains it better than the background does by min_log_odds, and by a quarter more than it does ordinary runs that the
background wasn't fitted on. Runs as short as the shortest labelled value are judged.
"""

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import hash_threshold, materialise, whole, texts

KINDS = ("assign", "access", "hex", "inferred")
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
MAYBE_ASSIGN = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LONG = 16
candidates = lambda least: re.compile(rf"[A-Za-z0-9+/_.=-]{{{least},}}")
CANDIDATE = candidates(LONG)
SAMPLE_DOCS = 20_000
SAMPLE_VALUES = 1_500
MIN_LOG_ODDS = 7.0
CREDENTIALS = 0.005
WORDY = re.compile(r"[A-Za-z0-9+/_.=-]{4,}")
VERDICTS = 1 << 17
CLASSES = {**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "U"), **{c: c for c in "+/_.=-"}}
MEMBERS = Counter(CLASSES.values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value), code points; each kind leftmost and non-overlapping."""
    found = []
    low = text.lower()
    if any(word in low for word in MAYBE_ASSIGN):  # lower() maps no other letters away from these, so nothing is lost
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


class State:
    """count: strings that came here; final: those that ended; chars: what followed; after: next state by character class."""

    __slots__ = ("after", "chars", "count", "final", "into")

    def __init__(self):
        self.count, self.final, self.chars, self.after, self.into = 0, 0, Counter(), {}, None

    def add(self, other: "State") -> None:
        self.count, self.final = self.count + other.count, self.final + other.final
        self.chars.update(other.chars)


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible states of their prefix tree.

    First states of one depth are merged, from the root on, which adds up the counts below them: those that fewer than least
    strings came to are no evidence, and are one state together. Then states of any depths are merged, only where least
    strings or more came to both. So a format of fixed length stays a chain, and one of any length becomes a loop.
    """

    def __init__(self, strings: list[str], alpha: float = 0.05, least: int = 30):
        self.bound, self.least = math.sqrt(0.5 * math.log(2 / alpha)), least
        self.root = State()
        for s in sorted(strings):
            state = self.root
            state.count += 1
            for c in s:
                state.chars[c] += 1
                state = state.after.setdefault(CLASSES[c], State())
                state.count += 1
            state.final += 1
        self.states = self._across(self._by_depth())

    def _by_depth(self) -> list[State]:
        """All states after merging within depths, the root first."""
        found, layer = [], [self.root]
        while layer:
            found += layer
            edges = [(parent, sign) for parent in layer for sign in sorted(parent.after)]
            few, kept = None, []
            for parent, sign in edges:  # those without evidence together
                node = parent.after[sign]
                if node.count < self.least:
                    if few is None:
                        few = node
                    else:
                        self._graft(few, node)
                    parent.after[sign] = few
            for parent, sign in sorted(edges, key=lambda e: -e[0].after[e[1]].count):  # a stable order: ties stay as they were
                node = parent.after[sign]
                if node in kept:
                    continue
                old = next((k for k in kept if self._compatible(k, node)), None)
                if old is None:
                    kept.append(node)
                else:
                    self._graft(old, node)
                    for p, c in edges:
                        if p.after[c] is node:
                            p.after[c] = old
            layer = kept
        return found

    @staticmethod
    def _graft(old: State, new: State) -> None:
        """Adds the tree under new to the one under old."""
        todo = [(old, new)]
        while todo:
            a, b = todo.pop()
            a.add(b)
            for sign, kid in b.after.items():
                if sign in a.after:
                    todo.append((a.after[sign], kid))
                else:
                    a.after[sign] = kid

    def _across(self, states: list[State]) -> list[State]:
        """The states left when compatible ones of different depths are merged."""
        kept: list[State] = []
        for new in states:
            new = self._now(new)
            if new in kept:
                continue
            enough = new.count >= self.least
            old = next((k for k in kept if enough and k.count >= self.least and self._compatible(k, new)), None)
            if old is None:
                kept.append(new)
            else:
                self._join(old, new)
                kept = list(dict.fromkeys(map(self._now, kept)))
        return list(dict.fromkeys(map(self._now, kept)))

    @staticmethod
    def _now(state: State) -> State:
        """What the state has become."""
        while state.into is not None:
            state = state.into
        return state

    def _join(self, old: State, new: State) -> None:
        """Makes one state of the two, and of those that one class leads to from it; each state's counts are added once."""
        todo = [(old, new)]
        while todo:
            a, b = map(self._now, todo.pop())
            if a is b:
                continue
            a.add(b)
            b.into = a
            for sign, kid in b.after.items():
                if sign in a.after:
                    todo.append((a.after[sign], kid))
                else:
                    a.after[sign] = kid

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, old: State, new: State) -> bool:
        todo, seen = [(old, new)], set()
        while todo:
            a, b = map(self._now, todo.pop())
            if a is b or (id(a), id(b)) in seen:
                continue
            seen.add((id(a), id(b)))
            if self._differ(a.final, a.count, b.final, b.count):
                return False
            if any(self._differ(a.chars[c], a.count, b.chars[c], b.count) for c in a.chars.keys() | b.chars.keys()):
                return False
            todo += [(a.after[sign], kid) for sign, kid in b.after.items() if sign in a.after]
        return True

    def table(self) -> list[tuple[dict[str, tuple[float, int]], float]]:
        """For each state: log probability and next state of each character, and the log probability of the end.

        A character unseen at a state shares its class's weight; a class unseen leads where most strings went from there.
        """
        number = {id(s): i for i, s in enumerate(self.states)}
        out = []
        for s in self.states:
            total = s.count + 0.1 * (len(MEMBERS) + 1)
            by_class = Counter()
            for c, n in s.chars.items():
                by_class[CLASSES[c]] += n
            after = {sign: number[id(self._now(kid))] for sign, kid in s.after.items()}
            usual = after[max(sorted(after), key=lambda sign: by_class[sign])] if after else 0
            moves = {}
            for c, sign in CLASSES.items():
                p = (by_class[sign] + 0.1) / total * (s.chars[c] + 0.5) / (by_class[sign] + 0.5 * MEMBERS[sign])
                moves[c] = (math.log(p), after.get(sign, usual))
            out.append((moves, math.log((s.final + 0.1) / total)))
        return out


def likelihood(table, s: str) -> tuple[float, float]:
    """The log likelihood of the string, and how much of it the end has."""
    at, total = 0, 0.0
    for c in s:
        p, at = table[at][0][c]
        total += p
    return total + table[at][1], table[at][1]


def log_likelihood(table, s: str) -> float:
    return likelihood(table, s)[0]


def quantile(values: list[float], q: float) -> float:
    return sorted(values)[min(len(values) - 1, int(q * len(values)))]


def least_typical(values: list[str]) -> tuple[float, float]:
    """(log likelihood a character, log likelihood of the end) that all but the oddest fiftieth of a format's values reach, each
    judged by an automaton of the other half of the values. Very few values are judged by their own, with more patience."""
    halves, patience = (values[0::2], values[1::2]), 0.25
    if len(values) < 8:
        halves, patience = (values, values), 1.0
    scores = [(*likelihood(table, s), len(s) + 1) for own, other in (halves, halves[::-1]) for table in [Automaton(other).table()] for s in own]
    return quantile([x / n for x, _, n in scores], 0.02) - patience, quantile([end for _, end, _ in scores], 0.02) - 4 * patience


class Scanner:
    """tables: the background's automaton, then one for each kind with labelled credentials. least: the shortest run that is
    judged. floors: for each kind what a run of its format reaches, as least_typical has it, if that is asked for."""

    def __init__(self, tables: list, min_log_odds: float = MIN_LOG_ODDS, least: int = LONG, floors: list[tuple[float, float]] | None = None):
        self.tables, self.min_log_odds, self.floors = tables, min_log_odds, floors or [(-math.inf, -math.inf)] * (len(tables) - 1)
        self.candidate = candidates(least)
        self.verdicts: dict[str, bool] = {}

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All (start, kind's place, end), by start, then kind. Inferred spans overlap no base span."""
        base = [x[:3] for x in base_spans(text)]
        return sorted(base + self._inferred(text, base)) if len(self.tables) > 1 else base

    def _inferred(self, text: str, base: list) -> list[tuple[int, int, int]]:
        found = []
        for m in self.candidate.finditer(text):
            if self._secret(m[0]):
                a, b = m.span()
                if not any(x[0] < b and a < x[2] for x in base):
                    found.append((a, 3, b))
        return found

    def _secret(self, s: str) -> bool:
        """Most runs are words that come again."""
        verdict = self.verdicts.get(s)
        if verdict is None:
            if len(self.verdicts) >= VERDICTS:
                self.verdicts.clear()
            verdict = self.log_odds(s) >= self.min_log_odds
            if len(s) <= 4 * LONG:
                self.verdicts[s] = verdict
        return verdict

    def log_odds(self, s: str) -> float:
        """Of the best of the kinds whose format the run has, against the background."""
        best = -math.inf
        for table, (each, last) in zip(self.tables[1:], self.floors, strict=True):
            x, end = likelihood(table, s)
            if x >= each * (len(s) + 1) and end >= last:
                best = max(best, x)
        return best - log_likelihood(self.tables[0], s) if best > -math.inf else best


def fitted(ordinary: list[str], values: list[list[str]], min_log_odds: float = MIN_LOG_ODDS, least: int = LONG) -> Scanner:
    """A scanner from ordinary runs, of which some may be credentials, and each kind's labelled values.

    A run that has a kind's format, and min_log_odds or more against the background, is taken for a credential and left out;
    then the background is fitted again, until that changes nothing. Half of the ordinary runs fit it. The bar is set by the
    other half: a quarter above what all but CREDENTIALS of them reach.
    """
    fit, apart = ordinary[0::2], ordinary[1::2]
    kinds, floors = [Automaton(v).table() for v in values], [least_typical(v) for v in values]
    left_out: set[str] = {s for s in fit if len(s) >= LONG}  # to begin with, short runs alone: hardly any of them are credentials
    for _ in range(4):
        scanner = Scanner([Automaton([s for s in fit if s not in left_out] or ["x"]).table(), *kinds], min_log_odds, least, floors)
        now = {s for s in fit if scanner.log_odds(s) >= min_log_odds} if kinds else set()
        if now == left_out:
            break
        left_out = now
    scores = [x for x in map(scanner.log_odds, apart) if x < min_log_odds] if kinds else []
    reached = quantile(scores, 1 - CREDENTIALS) if scores else -math.inf
    return Scanner(scanner.tables, max(min_log_odds, 1.25 * reached), least, floors)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_values: int = SAMPLE_VALUES, min_log_odds: float = MIN_LOG_ODDS) -> Scanner:
    """Learns from a uniform sample of sample_docs documents (a documented bound) and at most sample_values distinct
    values of each kind, and as many long and short ordinary runs. The sample's values are found on the executors; only
    those up to the bound come to the driver."""
    key, last = hash_threshold(docs.select("doc_id"), sample_docs)
    sample = docs.where(key <= last).select("text")

    def run(batches):
        for batch in batches:
            found = set()
            for text in texts(batch.column("text")):
                base = base_spans(text)
                found.update((KINDS[k], value) for _, k, _, value in base)
                found.update(("long" if m.end() - m.start() >= LONG else "short", m[0]) for m in WORDY.finditer(text) if not any(x[0] < m.end() and m.start() < x[2] for x in base))
            found = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["kind", "value"])

    values = materialise(sample.mapInArrow(run, "kind string, value string").distinct(), "secret-values")

    def some(kind):
        rows = values.where(F.col("kind") == kind)
        return [r["value"] for r in rows.orderBy(F.md5(F.col("value").cast("binary")), "value").limit(sample_values).collect()]

    known = [found for found in map(some, KINDS[:3]) if found]
    least = values.where(F.col("kind").isin(*KINDS[:3])).agg(F.min(F.length("value"))).first()[0]
    return fitted(some("short") + some("long"), known, min_log_odds, min(LONG, least or LONG))


@whole
def find(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end>> in order of start, then kind.

    Offsets count code points; ends are exclusive. Null and empty texts have no spans. Without any labelled credential in
    the sample only the fixed rules apply. A very long text, or run, is scanned whole. Repeated rows each give a row; an empty table gives none; other columns are not
    read.
    """
    return _found(docs, scanner or train(docs))


def _found(docs: DataFrame, scanner: Scanner) -> DataFrame:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.spans(t)] for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


@whole
def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_inferred, base_sha256, spans (kind:start:end, comma-joined): one row per document.

    Null and empty texts have no spans: counts of 0, the digest of nothing and an empty string. Spans of one start stand by kind.
    A very long text is scanned whole. Repeated rows each give a row; an empty table gives none; other columns, whatever
    their names, are not read.
    """
    found = _found(docs, train(docs))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


@whole
def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans replaced by mark; n_chars, if there, follows the text. All rows and columns stay.

    Null and empty texts, and those without a secret, stay as they are. A very long text is scanned whole. Repeated rows stay as
    often as they come; an empty table stays empty.
    """
    scanner = train(docs)
    counted = "n_chars" in docs.columns

    def clean(text: str) -> str:
        out, at = [], 0
        for a, _, b in scanner.spans(text):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    def run(batches):
        for batch in batches:
            column = batch.schema.get_field_index("text")
            old = batch.column(column).to_pylist()
            new = [t and clean(t) for t in old]
            if counted:
                place = batch.schema.get_field_index("n_chars")
                sizes = [n if a == b else len(b) for n, a, b in zip(batch.column(place).to_pylist(), old, new)]
                batch = batch.set_column(place, batch.schema.field(place), pa.array(sizes, batch.schema.field(place).type))
            yield batch.set_column(column, batch.schema.field(column), pa.array(new, batch.schema.field(column).type))

    return docs.mapInArrow(run, docs.schema)

