"""Secret scan, token files, BPE, mixing, language id and quality against plain restatements."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathom.llm import hmm_lm, lang_id, quality_fm, secret_scan, segtree_bpe, source_mix, token_planes
from fathom.llm.chunks import parts

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def bpe():
    return segtree_bpe.Bpe(RANKS, P.PATTERN)


@pytest.fixture(scope="session")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t'aeslt1.é日\x1c\x85　!")) | st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_bpe_is_exact(bpe, reference, batch):
    for text, ids in zip(batch, bpe.encode(batch)):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert bpe.decode(ids.tolist()) == text.encode()


def test_bpe_of_a_long_piece(bpe, reference):
    text = "abcab" * 8000
    assert bpe.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_bpe_of_a_very_long_run_takes_seconds(bpe, reference):
    import random
    import time

    rng = random.Random(4)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    began = time.perf_counter()
    assert bpe.encode([text])[0].tolist() == reference.encode_ordinary(text)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("kind", ["random", "ab", "one"])
def test_bpe_of_a_piece_that_goes_alone(bpe, reference, kind, monkeypatch):
    import random

    rng = random.Random(1)
    for n in (2, 3, 5, 64, 1000, 70_001):
        text = {"random": "".join(rng.choice("etaoinshrdlu") for _ in range(n)), "ab": "ab" * n, "one": "x" * n}[kind][:n]
        ids = np.frombuffer(bpe._merge_long(text.encode()), "<u4").tolist()
        assert ids == bpe.encode([text])[0].tolist() if n < 64 and text.encode() in bpe.ranks else ids == reference.encode_ordinary(text)


def test_bpe_of_megabytes_without_a_space_in_bounded_memory():
    """4 MB of letters in a process of its own: the text's merges take tens of bytes a byte."""
    script = (
        "import resource, random, hashlib, public_tokenizers as P\n"
        "from fathom.llm.segtree_bpe import Bpe\n"
        "bpe = Bpe(P.path('byte_bpe_multi_50k.tiktoken'), P.PATTERN)\n"
        "rng = random.Random(2)\n"
        "text = ''.join(rng.choices('etaoinshrdlu', k=4_000_000))\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "ids = bpe.encode([text])[0]\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, bpe.decode(ids.tolist()) == text.encode(), len(ids))\n"
    )
    import subprocess
    import sys

    grown, same, n = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, timeout=600).stdout.split()
    assert same == "True" and int(n) > 1_000_000 and int(grown) < 220_000  # KB


def test_bpe_digests(spark, odd_docs, no_docs, reference):
    wanted = []
    for r in odd_docs.collect():
        ids = reference.encode_ordinary(r.text or "")
        wanted.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert Counter(map(tuple, segtree_bpe.digests(odd_docs, RANKS, P.PATTERN).collect())) == Counter(wanted)
    assert segtree_bpe.digests(no_docs, RANKS, P.PATTERN).count() == 0
    full = segtree_bpe.encode_and_decode(odd_docs, RANKS, P.PATTERN).where("doc_id = 8").first()
    assert bytes(full.decoded).decode() == "日本語 é ñ \x1c end" and full.n_tokens == len(full.ids)


ODD_PIECES = st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", " \t", "don't", "'S", "é", "日本", "\x1c", "\x85", "\u3000", "1²", "word", " word", "word,", "À"]) | st.text(st.characters(codec="utf-8"), max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(ODD_PIECES, max_size=14).map("".join), max_size=4))
def test_texts_encode_as_the_plain_library_does(batch):
    encode, plain = token_planes.loaded(JSON), Tokenizer.from_file(JSON)
    for text, ids in zip(batch, encode(batch), strict=True):
        assert "".join(parts(text)) == text
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, token_planes.BLOCK, token_planes.BLOCK * 2 + 5])
def test_planes_round_trip(kind, n):
    import numpy as np

    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (token_planes.unpack(*token_planes.pack(ids, kind), n, kind) == ids).all()


def test_token_files(spark, odd_docs, no_docs):
    whole = Tokenizer.from_file(JSON)
    odd_docs = odd_docs.unionByName(odd_docs.where("doc_id = 1").withColumns({"doc_id": F.lit(11), "text": F.lit("hello <|endoftext|> world")}))
    start, wanted = 0, []
    for r in sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(map(tuple, token_planes.write_and_read(odd_docs, JSON).collect()), key=str) == sorted(wanted, key=str)
    assert token_planes.write_and_read(no_docs, JSON).count() == 0
    chunks = token_planes.write(odd_docs, JSON, 2, "bit")
    assert token_planes.read(chunks, "bit").where("doc_id = 2").first().ids == [2]


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_of(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "token", "api_key", "APIKEY", "secret", "ſecret", "toKen", "=", ": ", " ", '"', "'", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789ab", "é", "\n", "x"]), max_size=14))
def test_base_spans(pieces):
    text = "".join(pieces)
    assert [x[:3] for x in secret_scan.base_spans(text)] == base_of(text)


def test_secret_digest(spark, odd_docs, no_docs):
    got = secret_scan.digest(odd_docs).collect()
    assert len(got) == odd_docs.count()
    text = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in got:
        base = base_of(text[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    assert secret_scan.digest(no_docs).count() == 0


def test_redaction_keeps_rows_and_columns(odd_docs):
    out = secret_scan.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert "hunter2secret" not in out.where("doc_id = 9").first().text and out.where("doc_id = 1").first().text is None
    assert out.where("doc_id = 5").first().n_chars == odd_docs.where("doc_id = 5").first().n_chars


def test_inferred_formats():
    import random

    rng = random.Random(1)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    keys = ["AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16) for _ in range(300)]
    usual = [pick("aeinorst", rng.randint(16, 24)) for _ in range(600)] + [pick("0123456789", 16) for _ in range(200)]
    background, access = secret_scan.Automaton(usual), secret_scan.Automaton(keys)
    assert len(access.states) > 4
    scanner = secret_scan.Scanner([background.table(), access.table()])
    assert scanner.log_odds("AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 14)) > 7
    assert all(scanner.log_odds(s) < 0 for s in usual[:50] + ["4444333322221111", "internationalisation"])
    assert scanner.spans("see AKIA0123ABCD4567EF now")[0] == (4, 3, 22)
    for table in (background.table(), access.table()):  # each state's moves and end are a distribution
        for moves, end in table:
            assert 0.9 < sum(math.exp(p) for p, _ in moves.values()) + math.exp(end) < 1.1


@pytest.mark.parametrize("length", [24, 10])
def test_unlabelled_secrets_are_found(spark, length):
    """Credentials of a labelled format stand bare in other documents, which the background is learnt from too."""
    import random

    rng = random.Random(5)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    word = lambda a, b: "".join(rng.choice(["an", "er", "the", "ing", "on", "tion", "es", "lich"]) for _ in range(rng.randint(a, b)))
    secret = lambda: pick("QXZJKVWY", length - 4) + pick("0123456789", 4)
    prose = lambda: " ".join([word(1, 4) for _ in range(30)] + [word(8, 10), word(8, 10)])
    bare = {1000 + i: secret() for i in range(30)}
    rows = [(i, f"{prose()} token = {secret()} {prose()}") for i in range(150)] + [(i, f"{prose()} {s} {prose()}") for i, s in bare.items()] + [(i, prose()) for i in range(2000, 2300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "inferred"] for r in secret_scan.find(docs).collect()}
    assert all(found[i] == [s] for i, s in bare.items())
    assert not any(spans for i, spans in found.items() if i not in bare)


def test_few_unlabelled_secrets_are_found_and_no_ordinary_runs(spark):
    """Nothing but a few credentials may stand among the unlabelled long runs; and ordinary long runs aren't taken for them."""
    import random

    rng = random.Random(8)
    pick = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    secret = lambda: "ghx_" + pick(36)
    bare = [secret() for _ in range(5)]
    labelled = [(i, f"the value is token={secret()} here") for i in range(600)]
    found = {r.doc_id: r.spans for r in secret_scan.digest(spark.createDataFrame(labelled + [(1000 + i, f"see {s} now") for i, s in enumerate(bare)], "doc_id long, text string")).collect()}
    assert all(found[1000 + i] == "inferred:4:44" for i in range(5))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    mixed = docs.unionByName(spark.createDataFrame([(10**6 + i, f"{t} and {s}") for (i, t), s in zip(labelled, [secret() for _ in range(40)])], "doc_id long, text string"))
    scanner = secret_scan.train(mixed)
    assert all(len(table) > 10 for table in scanner.tables)  # the background's, and those of the labelled kinds
    got = {r.doc_id: r.n_inferred for r in secret_scan.digest(mixed).collect()}
    assert sum(got[10**6 + i] == 1 for i in range(40)) == 40
    assert sum(n for i, n in got.items() if i < 10**6) <= 1


def test_states_of_a_fixed_format_are_a_chain():
    import random

    rng = random.Random(2)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(400)]
    assert 30 <= len(secret_scan.Automaton(values).states) <= 40
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.choice([4, 5, 6, 7, 8, 9, 10, 12]))) for _ in range(2000)]
    assert 1 < len(secret_scan.Automaton(words).states) < 60


def test_water_filling_follows_the_rule(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 500, None: 2000, "e": 0}
    rows = spark.createDataFrame([(("-" if s is None else "+" + s), s, n) for s, n in sizes.items()], "sk string, source string, source_size long")
    got = {r.source: r.target for r in source_mix.targets(rows).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, room, open_ = {}, float(sum(sizes.values())), set(sizes)
    while True:
        level = room / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        room -= sum(3 * sizes[s] for s in over)
        open_ -= over
    assert got == pytest.approx(target)


def test_mix_hits_targets(spark, odd_docs, no_docs):
    got = source_mix.mix(odd_docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, source_mix.mix(odd_docs).collect()), key=str)
    assert len(got) == odd_docs.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert source_mix.mix(no_docs).count() == 0
    mixed = source_mix.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0d]+", r.text)) for r in mixed.select("text").collect()) == sum(r.taken for r in got)


def test_language_model(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    words = lambda r: (r.text or "").encode().lower().split()
    held = lambda r: zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 10 == 0
    counts = Counter(w for r in rows if not held(r) for w in words(r))
    texts = sum(not held(r) for r in rows)
    n, v = sum(counts.values()) + texts, len(counts) + 1
    counts[None] = texts
    wanted = []
    for r in rows:
        tokens = [*words(r), None]
        wanted.append((r.doc_id, held(r), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), 4)))
    got = hmm_lm.score(odd_docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == sorted(wanted, key=str)
    assert all(math.isfinite(r.score) for r in got)
    assert hmm_lm.score(no_docs).count() == 0


def test_forward_and_backward_are_the_sums_over_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    model = hmm_lm.Model.of(rng.random(3), rng.random((3, 3)), rng.random((5, 3)))
    sequences = [np.array(s) for s in ([0, 3, 2, 4], [1], [2, 2, 0])]
    counts = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    got = model.forward_backward(sequences, counts)
    want_t, want_e = np.zeros((3, 3)), np.zeros((5, 3))
    for s, log in zip(sequences, got):
        paths = list(itertools.product(range(3), repeat=len(s)))
        p = [model.start[k[0]] * np.prod([model.emission[x, j] for x, j in zip(s, k)]) * np.prod([model.transition[a, b] for a, b in zip(k, k[1:])]) for k in paths]
        assert 10**log == pytest.approx(sum(p))
        for path, weight in zip(paths, np.array(p) / sum(p)):
            for x, k in zip(s, path):
                want_e[x, k] += weight
            for a, b in zip(path, path[1:]):
                want_t[a, b] += weight
    assert np.allclose(counts[1], want_t) and np.allclose(counts[2], want_e)


def test_long_sequences_go_by_segments(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    model = hmm_lm.Model.of(rng.random(3), rng.random((3, 3)), rng.random((5, 3)))
    sequences = [rng.integers(0, 5, n) for n in (3, 40, 41, 1, 7)]
    results = []
    for segment in (1 << 16, 8):
        monkeypatch.setattr(hmm_lm, "SEGMENT", segment)
        counts, gammas = (np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))), {}

        def seen(which, gamma, gammas=gammas):
            gammas |= {(k, t): g for k, t, g in zip(which[0].tolist(), which[1].tolist(), gamma)}

        logs = model.forward_backward(sequences, counts, seen)
        results.append([logs, *counts, np.array([gammas[k, t] for k, s in enumerate(sequences) for t in range(len(s))])])
    assert all(np.allclose(x, y) for x, y in zip(*results))


def test_language_model_scores_are_those_of_a_plain_restatement(spark):
    """Baum-Welch, the words' leanings and the forward recursion in loops, with few symbols, so that most words are in tables. All
    training words have tokens by state, those seen once too."""
    import random

    import numpy as np

    from fathom.llm.wordhash import words

    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    docs = [(i, " ".join(rng.choice(vocabulary[(i % 2) * 12 :][:18]) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(60, "never seen"), (61, None), (62, "once is enough for a word")]
    states, rounds, n_symbols, n_frequent = 3, 2, 4, 9
    found = {w: words([w.encode()]) for w in {*vocabulary, *"never seen once is enough for a word".split()}}
    number, kind = {w: int(f.hash.view(np.int64)[0]) for w, f in found.items()}, {w: int(hmm_lm.word_class(f)[0]) for w, f in found.items()}
    split = {i: (t or "").split() for i, t in docs}
    train = [i for i in split if zlib.crc32(str(i).encode()) % 10]
    n = Counter(w for i in train for w in split[i])
    ranked = sorted(n, key=lambda w: (-n[w], number[w]))
    top = {w: k for k, w in enumerate(ranked[:n_symbols])}
    classes = {c: [c, sum(n[w] for w in n if kind[w] == c and w not in top), sum(kind[w] == c and w not in top for w in n)] for c in {kind[w] for w in n}}
    lex = hmm_lm.Lexicon([(number[w], n[w], kind[w]) for w in ranked[:n_frequent]], n_symbols, list(classes.values()), len(train), sum(n.values()) + len(train), len(n) + 1)
    symbol = lambda w: top.get(w, n_symbols + kind[w])
    model = hmm_lm.Model.first(lex, states, 3)

    def passes(emitted):
        alpha, beta = [model.start * emitted[0]], [np.ones(states)]
        for e in emitted[1:]:
            alpha.append((alpha[-1] @ model.transition) * e)
        for e in emitted[:0:-1]:
            beta.insert(0, model.transition @ (e * beta[0]))
        return alpha, beta, alpha[-1].sum()

    def parts_of(shares, whole):
        upto = np.floor(np.cumsum(shares) * whole + 0.5)
        return np.diff(np.append(upto[:-1], whole), prepend=0) / whole

    for _ in range(rounds):
        start, transition, emission, by_word, by_class = np.zeros(states), np.zeros((states, states)), np.zeros(model.emission.shape), {}, np.zeros((hmm_lm.CLASSES, states))
        for i in train:
            seq = [*map(symbol, split[i]), lex.end]
            emitted = model.emission[seq]
            alpha, beta, total = passes(emitted)
            start += alpha[0] * beta[0] / total
            for t, k in enumerate(seq):
                g = alpha[t] * beta[t] / total
                emission[k] += g
                if t:
                    transition += np.outer(alpha[t - 1], emitted[t] * beta[t]) * model.transition / total
                if n_symbols <= k < lex.end:
                    w = split[i][t]
                    by_word[w] = by_word.get(w, 0) + (g if w in ranked[:n_frequent] else parts_of(g, hmm_lm.PARTS))
        model = hmm_lm.Model.of(start + 0.1, transition + 0.1, emission + 0.01)
    for w, g in by_word.items():  # rarer words' shares are kept in 20 bits each
        by_word[w] = g if w in ranked[:n_frequent] else n[w] * parts_of(g / n[w], (1 << 20) - 1)
        by_class[kind[w]] += by_word[w]
    wanted = {}
    for i, ws in split.items():
        emitted, share = [], 0.0
        for w in ws:
            e = model.emission[symbol(w)].copy()
            if w not in top:
                c = classes.get(kind[w], [0, 0, 0])
                share += math.log10((n[w] + 0.1) / (c[1] + 0.1 * (c[2] + 1)))
                if w in by_word:
                    usual = by_class[kind[w]] / by_class[kind[w]].sum()
                    e *= (0.7 * by_word[w] / usual + 0.3 * n[w] + 0.1) / (n[w] + 0.1)
            emitted.append(e)
        wanted[i] = share + math.log10(passes([*emitted, model.emission[lex.end]])[2])
    got = hmm_lm.score(spark.createDataFrame(docs, "doc_id long, text string"), states=states, rounds=rounds, symbols=n_symbols, frequent=n_frequent).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(wanted, rel=1e-6)
    for c in range(hmm_lm.CLASSES):  # a class's words and its one unseen word have a probability of one together, in each state
        own = [w for w in n if kind[w] == c and w not in top]
        if own and by_class[c].any():
            usual = by_class[c] / by_class[c].sum()
            size = classes[c][1] + 0.1 * (classes[c][2] + 1)
            assert sum((0.7 * by_word[w] / usual + 0.3 * n[w] + 0.1 if w in by_word else n[w] + 0.1) / size for w in own) + 0.1 / size == pytest.approx(np.ones(states))
    assert set(by_word) == set(n) - set(top) and n["enough"] == 1 and sum(n[w] == 1 for w in by_word) > 3


def test_language_model_beats_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, model = hmm_lm.score(docs).where("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert model > base


def test_language_id(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in lang_id.predict(odd_docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got.values()) and lang_id.predict(odd_docs).count() == odd_docs.count()
    assert lang_id.predict(no_docs).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = lang_id.predict(docs).where("held_out").join(docs, "doc_id").selectExpr("avg(cast(lang_pred = lang as int))").first()[0]
    assert right > 0.97


def test_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(20, 60)] + [(None, 1, 0), (20, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_fm.score(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert quality_fm.score(no_docs, labels).count() == 0
    kept = quality_fm.accepted(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in got)
    docs, real = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    right = quality_fm.score(docs, real).where("held_out").join(real, "doc_id").selectExpr("avg(cast(predicted = quality as int))").first()[0]
    assert right > 0.95


def test_factorisation_identity():
    import numpy as np

    machine = quality_fm.Machine()
    machine.w = np.random.default_rng(1).normal(size=quality_fm.WIDTH)
    bounds, at, x = quality_fm.features([b"one two two three", b""], np.array([17, -1]))
    got = machine.logits(bounds, at, x)
    for i in range(2):
        a, v = at[bounds[i] : bounds[i + 1]], x[bounds[i] : bounds[i + 1]]
        pairs = sum(machine.v[a[j]] @ machine.v[a[k]] * v[j] * v[k] for j in range(len(a)) for k in range(j))
        assert got[i] == pytest.approx(machine.bias + machine.w[a] @ v + pairs)


def test_language_features_are_tf_idf_of_hashed_n_grams():
    import numpy as np

    def code(gram):
        run = 0
        for c, step in zip(gram, lang_id.STEPS):
            run = (run + ord(c) + 1) * int(step) & 0xFFFFFFFF
            run ^= run >> 15
        return run >> 32 - lang_id.BITS

    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 5, 1 << lang_id.BITS)
    text = "Été in Łódź, straße 12"
    low = text.lower()
    tf = Counter(code(low[i : i + k]) for k in (1, 2, 3) for i in range(len(low) - k + 1))
    raw = {f: (1 + math.log(n)) * idf[f] for f, n in tf.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    at, x = lang_id.Model(["a"], idf).features(text)
    assert dict(zip(at.tolist(), x.tolist())) == pytest.approx({f: v / norm for f, v in raw.items()})


def test_language_training_is_ftrl_with_elastic_net_and_a_temperature():
    import numpy as np

    rng = np.random.default_rng(4)
    width, languages, alpha, beta, l1, l2 = 12, ["a", "b", "c"], 0.5, 1.0, 0.02, 0.02
    rows = []
    for _ in range(300):
        at = np.sort(rng.choice(width, 4, replace=False))
        rows.append((at, rng.uniform(0, 1, 4), int(at[0] % 3 if rng.random() < 0.8 else rng.integers(3))))
    model = lang_id.Model(languages, np.ones(width)).fit(rows, alpha, beta, l1, l2, epochs=2)
    z, n = [[0.0] * 3 for _ in range(width + 1)], [[0.0] * 3 for _ in range(width + 1)]

    def weight(i, k):
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - math.copysign(l1, z[i][k])) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    def probabilities(s):
        e = [math.exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]

    for _ in range(2):
        for i, (at, x, y) in enumerate(rows):
            if i % 10:
                features = [*zip(at.tolist(), x.tolist()), (width, 1.0)]
                w = {(f, k): weight(f, k) for f, _ in features for k in range(3)}
                p = probabilities([sum(v * w[f, k] for f, v in features) for k in range(3)])
                for f, v in features:
                    for k in range(3):
                        g = v * (p[k] - (k == y))
                        z[f][k] += g - (math.sqrt(n[f][k] + g * g) - math.sqrt(n[f][k])) / alpha * w[f, k]
                        n[f][k] += g * g
    assert np.allclose(model.weights, [[weight(i, k) for k in range(3)] for i in range(width)]) and np.allclose(model.bias, [weight(width, k) for k in range(3)])

    def loss(t):
        return sum(-math.log(probabilities((model.logits(at, x) / t).tolist())[y]) for at, x, y in rows[::10])

    assert all(loss(model.temperature) <= loss(model.temperature * f) + 1e-6 for f in (0.9, 0.99, 1.01, 1.1))


def test_rare_languages_are_learnt(spark):
    """A language of one document in some hundreds is drawn for the fit like any other."""
    rows = [(i, "the cat sat on the mat with the dog " * 3, "en") for i in range(700)] + [(1000 + i, "žluťoučký kůň pěl ďábelské ódy " * 3, "cs") for i in range(4)]
    got = lang_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=60).where("doc_id >= 1000").collect()
    assert len(got) == 4 and all(r.lang_pred == "cs" for r in got)


def test_factorisation_training_is_a_plain_restatement(monkeypatch):
    import numpy as np

    monkeypatch.setattr(quality_fm, "BATCH", 5)
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(17):
        at = np.sort(rng.choice(30, 5, replace=False)).astype(np.int64)
        rows.append((at, rng.uniform(0.1, 1, 5), int(at[0] % 2)))
    start, machine = quality_fm.Machine(), quality_fm.Machine().fit(rows, epochs=3)
    share = sum(y for _, _, y in rows) / len(rows)
    bias, w, v = math.log(share / (1 - share)), start.w[:30].tolist(), start.v[:30].tolist()
    w2, v2, factors = [1e-6] * 30, [[1e-6] * quality_fm.FACTORS for _ in range(30)], range(quality_fm.FACTORS)
    for _ in range(3):
        for first in range(0, len(rows), 5):
            gw, gv, errors = Counter(), Counter(), []
            for at, x, y in rows[first : first + 5]:
                f = list(zip(at.tolist(), x.tolist()))
                pairs = sum(sum(v[i][k] * v[j][k] for k in factors) * a * b for n, (i, a) in enumerate(f) for j, b in f[:n])
                error = 1 / (1 + math.exp(-(bias + sum(w[i] * a for i, a in f) + pairs))) - y
                errors.append(error)
                for i, a in f:
                    gw[i] += error * a
                    for k in factors:
                        gv[i, k] += error * a * sum(v[j][k] * b for j, b in f if j != i)
            for i in gw:
                g = gw[i] + 1e-4 * w[i]
                w2[i] += g * g
                w[i] -= 0.1 * g / math.sqrt(w2[i])
            for i, k in gv:
                g = gv[i, k] + 1e-4 * v[i][k]
                v2[i][k] += g * g
                v[i][k] -= 0.025 * g / math.sqrt(v2[i][k])
            bias -= 0.01 * sum(errors) / len(errors)
    assert machine.bias == pytest.approx(bias) and np.allclose(machine.w[:30], w) and np.allclose(machine.v[:30], v)


def test_words_of_two_letters_in_a_row_have_hashes_of_their_own():
    """Sequences that collide under every polynomial modulo 2**64."""
    from fathom.llm.wordhash import words

    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    found = words([one.encode(), one.translate(str.maketrans("ab", "ba")).encode(), b"x" * 300_000 + b" " + b"x" * 300_000])
    assert found.hash[0] != found.hash[1] and found.hash[2] == found.hash[3] and found.bounds.tolist() == [0, 1, 2, 4]
