"""Operators against plain Python over the same rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from keystate.llm import common, hmm, language_id, language_model, licences, media, mixing, multiset, packing, simhash, token_counts, token_output, tokens

from .conftest import SCHEMA
from .plain_packing import matched_runs


@pytest.fixture(scope="module")
def docs(spark, prose):
    extra = [(500, prose[0][1] + "\nit's <|endoftext|> at 12:30, don't!", "en", "s1"), (501, "  two  blanks \n\n and\ttabs ", "en", "s1"), (502, "ÀÉ ﬁ x² 日本語 한국어 'S 's", "fr", "s2"), (503, "▁ a▁b ▁▁", "fr", "s2"), (504, "a " * 5000, "en", "s0"), (505, None, "en", "s0")]
    return spark.createDataFrame([*prose, *extra], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_language_model_base_and_likelihood(docs, texts):
    got = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    toks = {d: [*words(t), None] for d, t in texts.items()}
    c = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in toks.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), abs=1e-6)
    out = [d for d in texts if held[d]]
    assert sum(got[d]["score"] for d in out) > sum(got[d]["base_score"] for d in out)


def test_forward_and_counts_equal_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    p = hmm.Parameters(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6, 2)]
    ids, offsets = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    starts, moves, emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, ll in zip(seqs, hmm.log_likelihoods(ids, offsets, p), strict=True):
        paths = {}
        for z in product(range(3), repeat=len(s)):
            q = p.start[z[0]] * p.emit[s[0], z[0]]
            for t in range(1, len(s)):
                q *= p.move[z[t - 1], z[t]] * p.emit[s[t], z[t]]
            paths[z] = q
        total = sum(paths.values())
        assert ll == pytest.approx(math.log(total))
        for z, q in paths.items():
            starts[z[0]] += q / total
            for t in range(len(s)):
                emissions[s[t], z[t]] += q / total
                if t:
                    moves[z[t - 1], z[t]] += q / total
    a, b, e, _ = hmm.expected_counts(ids, offsets, p)
    assert np.allclose(a, starts) and np.allclose(b, moves) and np.allclose(e, emissions)


def test_parts_of_texts_count_every_token_and_move_once():
    """Counts over parts with lead-in and lead-out are those of the whole texts, as states are soon forgotten."""
    rng = np.random.default_rng(7)
    p = hmm.Parameters(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3) * 4, 3), rng.dirichlet(np.ones(9), 3).T)
    texts = [rng.integers(0, 9, n) for n in (1, 40, 64, 65, 300, 777)]
    whole = hmm.expected_counts(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])]), p)
    codes, offsets, own = language_model._parts(texts, 64, 24)
    parts = hmm.expected_counts(codes, offsets, p, own)
    for a, b in zip(whole[:3], parts[:3], strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-3)
    assert parts[2].sum() == pytest.approx(sum(map(len, texts))) and parts[1].sum() == pytest.approx(sum(len(x) - 1 for x in texts))


def test_score_is_that_of_all_paths(spark, prose, monkeypatch):
    """``score`` against a dense forward over every class, from the parameters the training ended with, with words and counts in plain Python."""
    seen = []
    real = hmm.maximised
    monkeypatch.setattr(hmm, "maximised", lambda *a: seen.append(real(*a)) or seen[-1])
    docs = spark.createDataFrame(prose[:60], SCHEMA)
    got = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    p = seen[-1]
    c = Counter(w for d, t, _, _ in prose[:60] if zlib.crc32(str(d).encode()) % 10 for w in words(t))
    order = {w: i for i, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0])))}
    ending = lambda w: language_model.FREQUENT + zlib.crc32(w[-3:]) % language_model.ENDINGS
    for d, t, _, _ in prose[:60]:
        alpha, total = None, 0.0
        for w in [*words(t), None]:
            if w is None:
                e = p.emit[language_model.END_CLASS]
            elif w in order:  # all known words have a class of their own here
                e = p.emit[order[w]]
            else:  # the only word of its class, of which none has been seen: 0.1 of 0.1 * (0 + 1)
                e = p.emit[ending(w)]
            alpha = (p.start if alpha is None else alpha @ p.move) * e
            total += math.log10(alpha.sum())
            alpha /= alpha.sum()
        assert got[d]["score"] == pytest.approx(total, abs=1e-6)


def test_every_round_counts_all_learning_tokens(spark, prose, monkeypatch):
    """Parameters, the first ones included, come from no part of the documents: of few or of many tokens."""
    seen = []
    real = hmm.maximised
    monkeypatch.setattr(hmm, "maximised", lambda *a: seen.append(a) or real(*a))
    rows = [*prose[:40], (600, " ".join(t for _, t, _, _ in prose[:60]) * 9, "en", "s0")]
    learning = [words(t) for d, t, _, _ in rows if zlib.crc32(str(d).encode()) % 10]
    n = sum(len(w) + 1 for w in learning)
    assert max(map(len, learning)) > 2000
    assert language_model.score_documents(spark.createDataFrame(rows, SCHEMA)).first()["train_tokens"] == n
    assert len(seen) == language_model.ROUNDS
    for starts, moves, emissions, *_ in seen:
        assert starts.sum() == pytest.approx(len(learning)) and emissions.sum() == pytest.approx(n)
        assert moves.sum() == pytest.approx(n - len(learning))


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 10, 300) + 10 * (i % 2) for i in range(20)])
    offsets = np.arange(0, 6001, 300)
    shares = np.full(20, 0.05)
    p, before = hmm.seeded(shares, 2), -np.inf
    for _ in range(15):
        s, m, e, ll = hmm.expected_counts(ids, offsets, p)
        assert ll > before - 1e-6
        p, before = hmm.maximised(s, m, e, shares, 1e-6), ll
    assert before / len(ids) > math.log(1 / 10) - 0.1


def test_the_model_is_a_distribution():
    """The shared classes' words, unknown ones included, have probability one in their class."""
    class_n, class_v = 17.0, 4.0
    counts = [5, 7, 3, 2]
    assert sum((c + 0.1) / (class_n + 0.1 * (class_v + 1)) for c in [*counts, 0]) == pytest.approx(1)


def test_token_output(spark, docs, texts):
    path = common.new_path(spark, "test")
    token_output.write_ids(docs, path, block_ids=2000)
    got = {r["doc_id"]: r for r in token_output.read_ids(spark, path).collect()}
    library, start = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json")), 0
    for d in sorted(texts):
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 1]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), crc(ids))
        assert np.frombuffer(got[d]["ids"], "<u4").tolist() == ids
        start += len(ids)


def test_token_counts(docs, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    for r in token_counts.count_tokens(docs, limit=100).collect():
        t = texts[r["doc_id"]]
        n = len(library.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 100)


def test_packing(docs, texts):
    got = packing.pack(docs, most=256, keep_ids=True)
    rows = got.collect()
    library, by = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")), {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    total = 0
    for d, t in texts.items():
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 0], 0
        for i, r in enumerate(sorted(by[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at) and r["ids_crc32"] == crc(ids[at : at + r["length"]]) and (i == 0 or r["length"] == 256)
            at += r["length"]
        assert at == len(ids)
        total += at
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    lower = -(-total // 256)
    assert lower <= len(bins) <= lower * 1.06 + 2
    whole = packing.sequences(got).collect()
    assert {r["sequence_id"]: r["n_tokens"] for r in whole} == {s: sum(n for _, n in p) for s, p in bins.items()}
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)


def test_matched_runs_place_everything():
    rng = np.random.default_rng(1)
    for most in (1, 2, 10, 64):
        for _ in range(20):
            counts = np.concatenate([[0], rng.integers(0, 30, most)])
            runs, opened = matched_runs(counts, most)
            seen, fill = Counter(), {}
            for size, rank, n, first, place in runs:
                for i in range(n):
                    assert (size, rank + i) not in seen
                    seen[size, rank + i] = 1
                    fill.setdefault(first + i, []).append((place, size))
            assert sum(seen.values()) == counts.sum() and len(fill) == opened
            for parts in fill.values():
                at = 0
                for place, size in sorted(parts):
                    assert place == at
                    at += size
                assert at <= most


@pytest.mark.parametrize("kind", ["any", "one size", "short"])
def test_distributed_sweeps(spark, monkeypatch, kind):
    """All placed, none over the length, as few sequences as the plain version needs; over several range partitions."""
    rng = np.random.default_rng(3)
    sizes = {"any": rng.integers(1, 65, 900), "one size": np.r_[np.full(300, 40), np.full(200, 24), np.full(80, 64)], "short": rng.integers(1, 4, 700)}[kind]
    monkeypatch.setattr(packing, "ROWS", 300)
    placed, opened = packing.place(spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "pid long, size int").repartition(3), 64)
    rows = placed.collect()
    assert sorted(r["pid"] for r in rows) == list(range(len(sizes))) and all(r["size"] == sizes[r["pid"]] for r in rows)
    fill = Counter()
    for r in rows:
        fill[r["seq"]] += r["size"]
    assert max(fill.values()) <= 64 and len(fill) == opened
    assert opened <= matched_runs(np.bincount(sizes, minlength=65), 64)[1] * 1.01 + 1


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints(docs, texts):
    def slow(t):
        w = words(t)
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    fps = [slow(texts[d]) for d in ids]
    assert [got[d]["fingerprint"] for d in ids] == [f"{f:016x}" for f in fps]
    assert [got[d]["component_id"] for d in ids] == brute_components(fps, ids)


def test_links_find_every_near_pair(spark, monkeypatch):
    """Random fingerprints with neighbours at 1 to 4 bits, chains among them, and lists that are split."""
    rng = np.random.default_rng(4)
    fps = []
    for _ in range(60):
        f = int(rng.integers(0, 2**63))
        fps.append(f)
        for flips in (1, 2, 3, 3, 4):
            for _ in range(2):
                base = fps[-1] if rng.random() < 0.4 else f
                for b in rng.choice(64, flips, replace=False):
                    base ^= 1 << int(b)
                fps.append(base)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    from keystate.llm.components import components

    parent = {r["node"] % 2**64: r["root"] % 2**64 for r in components(simhash.links(df)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(parent.get(f, f), []).append(f)
    expected = {}
    for f, c in zip(fps, brute_components(fps, fps), strict=True):
        expected.setdefault(c, []).append(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_long_lists_are_split_without_loss():
    rng = np.random.default_rng(9)
    one = np.uint64(0x0123456700000000)
    fps = np.unique(one | rng.integers(0, 2**32, 3000).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, fps[:500] ^ np.uint64(0b11), fps[500:700] ^ np.uint64(1 << 31)]))

    def joined(pairs):
        parent = {int(f): int(f) for f in fps}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(int(a)), find(int(b))
            parent[max(a, b)] = min(a, b)
        return [find(int(f)) for f in fps]

    whole = list(zip(*simhash.forest(fps), strict=True))
    parts = [p for part in simhash._by_fifth(fps) for p in zip(*simhash.forest(part), strict=True)]
    assert joined(whole) == joined(parts)


def test_covering_sets_serve_any_five_positions():
    from itertools import combinations

    assert all(any(set(s) <= set(f) for s in simhash.SETS) for f in combinations(range(8), 5)) and len(simhash.SETS) == 14


def test_multiset_hash(spark, texts):
    def vector(t):
        v = [0] * 264

        for p in t.split("\n"):
            h = hashlib.sha256(p.encode()).hexdigest()
            for i in range(8):
                v[i] = (v[i] + int(h[8 * i : 8 * i + 8], 16)) % 2**32
            for x in p.split(". "):
                for c in (x[i : i + 64] for i in range(0, len(x), 64)):
                    item = int(hashlib.md5(c.encode()).hexdigest()[:3], 16) % 512
                    v[8 + item // 2] = (v[8 + item // 2] + (-1) ** (item % 2)) % 2**24
        return v

    from pyspark.sql import functions as F

    rows = [(d, t, "\n".join(reversed(t.split("\n"))), t.split("\n")[0], "\n".join(t.split("\n")[1:]) if "\n" in t else None) for d, t in texts.items()]
    df = spark.createDataFrame(rows, "d long, t string, r string, a string, b string")
    out = df.select("d", multiset.vector(F.col("t")).alias("v"), multiset.vector(F.col("r")).alias("w"), multiset.combined(multiset.vector(F.col("a")), multiset.vector(F.col("b"))).alias("s"), multiset.combined(multiset.vector(F.col("t")), multiset.vector(F.col("a")), -1).alias("m"), multiset.vector(F.col("b")).alias("vb"))
    for r in out.collect():
        assert r["v"] == r["w"] == vector(texts[r["d"]])
        if r["vb"] is not None:
            assert r["s"] == r["v"] and r["m"] == r["vb"]


def test_edited_text_and_next(docs, texts):
    got = {r["doc_id"]: r for r in multiset.compare_edited(docs).collect()}
    ids = sorted(texts)
    for d, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = texts[d], len(texts[d])
        edit = t[: n - n // 4] + texts[nxt][: n // 4]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (n, hashlib.sha256(edit.encode()).hexdigest())
        assert 0 <= got[d]["near_next"] <= 1 and 0 <= got[d]["near_edited"] <= 1
        assert (got[d]["fingerprint"] == got[d]["edited_fingerprint"]) == (sorted(t.split("\n")) == sorted(edit.split("\n")))
        if n > 200 and texts[nxt] != t:
            assert got[d]["near_edited"] > got[d]["near_next"]


def test_slices_meet_their_neighbours(spark):
    df = spark.createDataFrame([(i * 7 % 1009, f"t{i * 7 % 1009}") for i in range(1009)], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["next"] for r in multiset.with_next(df, rows=50).collect()}
    assert got == {i: f"t{(i + 1) % 1009}" for i in range(1009)}


def test_mixing_meets_targets(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)), None, ("a", "b", "c", "d", None)[min(4, int(rnd.expovariate(1.0)))]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()}
    assert {r["doc_id"]: r["taken"] for r in got} == again
    total = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        total[r["source"]] += r["taken"]
    target = {r["source"]: r["target"] for r in got}
    size = {r["source"]: r["source_size"] for r in got}
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-6 and abs(total[s] - target[s]) <= 60


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, "e": 20}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(sorted(sizes), (5, 2, 1, 5, 2), strict=True))
    left, free, expected = sum(sizes.values()), set(sizes), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            expected[s] = 3 * sizes[s]
            left -= expected[s]
            free.discard(s)
    assert got == pytest.approx(expected | share)


def test_language_held_out(docs, texts):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in language_id.identify(docs).collect() if r["held_out"] and r["doc_id"] < 500]
    assert len(got) > 30
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_fit_is_kernel_ridge_regression():
    """With every text a landmark, the scores are those of dense ridge regression on the kernel's features."""
    texts = [f"{a} {b} {c}".encode() for a in ("the river", "der fluss", "la rivière") for b in ("house", "straße", "maison", "morning") for c in ("one", "zwei", "trois")]
    labels = ["en"] * 12 + ["de"] * 12 + ["fr"] * 12
    m = language_id.fit(texts, labels, landmarks=len(texts), ridge=1e-3)
    x = language_id.matrix(texts).astype(np.float64)
    k, y = x @ x.T, (np.array(labels)[:, None] == np.array(m.languages)[None, :]).astype(float)
    # ridge with a free constant: centre, then (k + ridge n) a = y
    h = np.eye(len(k)) - 1 / len(k)
    a = np.linalg.solve(h @ k @ h + 1e-3 * len(k) * np.eye(len(k)), h @ y)
    dense = h @ k @ h @ a + y.mean(0)
    assert np.allclose(m.scores(texts), dense, atol=2e-3)


def test_languages_are_learned_from_texts_of_any_length(spark, prose):
    """A language of which there are only texts of over 64 KB is learned like the others."""
    long = " ".join(f"жук{i % 977} лес{i % 89} дом" for i in range(5000))
    assert len(long.encode()) > 1 << 16
    rows = [*prose[:60], *((700 + i, f"{i} {long[i:]}", "ru", "s0") for i in range(8))]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[700 + i] for i in range(8)} == {"ru"}


def test_training_counts_every_labelled_text(spark, monkeypatch):
    """Landmarks, sums of the regression and the least score, of over 2,400 texts, in plain Python over all of them."""
    rows = [(i, f"{'river house' if i % 5 else 'fluss haus'} {'ab cd ef gh'[i % 9 :]} {i * 7919 % 101:b} " + "morning " * (i % 40), "en" if i % 5 else "de", "s") for i in range(2700)]
    docs = spark.createDataFrame([*rows, (9001, None, "en", "s"), (9002, "no label", None, "s")], SCHEMA).repartition(3)
    seen = []
    real = language_id.Landmarks.solved
    monkeypatch.setattr(language_id.Landmarks, "solved", lambda self, sums, *a: seen.append((self, sums)) or real(self, sums, *a))
    model = language_id.train(docs)
    (marks, sums), n = seen[0], {"de": 540, "en": 2160}
    forms = [(t, lang) for _, text, lang, _ in rows for t in language_id._forms(text)]
    assert len(forms) > len(rows)
    phi = np.vstack([marks.features([t for t, _ in forms[i : i + 256]]) for i in range(0, len(forms), 256)])
    y = np.array([[lang == x for x in ("de", "en")] for _, lang in forms], float)
    weights = np.array([1 / n[lang] for _, lang in forms])
    assert np.allclose(sums, (phi * weights[:, None]).T @ np.hstack([phi, y]), rtol=1e-4, atol=1e-6)
    h = {r["doc_id"]: (r["i"], r["h"]) for r in docs.selectExpr("doc_id", f"pmod(xxhash64(string(doc_id), text), {language_id.LANDMARKS}) i", "pmod(shiftright(xxhash64(string(doc_id), text), 32), 65536) h").collect()}
    place, signed = {i: at for at, i in enumerate(sorted({h[r[0]][0] for r in rows}))}, np.zeros_like(marks.z)
    for d, text, lang, _ in rows:
        for k, t in enumerate(language_id._forms(text)):
            signed[place[h[d][0]]] += language_id.matrix([t])[0] * (1 - 2 * (h[d][1] >> k & 1)) / np.sqrt(n[lang])
    assert np.allclose(marks.z, signed, atol=1e-5)
    own = [model.scores([t])[0, model.languages.index(lang)] for t, lang in forms]
    assert language_id.least(docs, model) == pytest.approx(min(own), abs=1e-5)


def test_cosine_hash_against_plain_sums():
    rows = np.random.default_rng(1).integers(0, 256, (96, 24)).astype(np.uint8)
    up = np.repeat(np.repeat(rows.astype(float), 4, 1), 1, 0)  # 24 columns as 96, so each cell has 3 by 3 of equal parts
    cells = up.reshape(32, 3, 32, 3).mean((1, 3))
    low = [round(sum(cells[y, x] * math.cos(math.pi * (2 * y + 1) * i / 64) * math.cos(math.pi * (2 * x + 1) * j / 64) for y in range(32) for x in range(32)), 6) for i in range(8) for j in range(8)][1:]
    middle = sorted(low)[31]
    assert media.cosine_hash(rows) == f"{int('0' + ''.join('1' if v > middle else '0' for v in low), 2):016x}"


def test_kernel_is_common_grams_over_norms():
    a, b = b"river house", b"the river"
    x = language_id.matrix([a, b])
    ga, gb = set(language_id.presence(a).tolist()), set(language_id.presence(b).tolist())
    assert float(x[0] @ x[1]) == pytest.approx(len(ga & gb) / math.sqrt(len(ga) * len(gb)), rel=1e-5)


def test_media(docs, texts):
    for r in media.features(media.as_media(docs)).collect():
        t = texts[r["doc_id"]].encode()
        payload = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        png = media.encode_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest()) and len(r["feature"]) == 16


def test_png_filters_and_damage():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (40, 24), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40).astype(np.uint8)
    filtered = np.zeros_like(rows)
    for y in range(40):
        for x in range(24):
            a = int(rows[y, x - 1]) if x else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 1]) if x and y else 0
            guess = [0, a, b, (a + b) // 2, media._paeth(a, b, c)][kinds[y]]
            filtered[y, x] = (int(rows[y, x]) - guess) % 256
    assert (media.unfilter(kinds, filtered) == rows).all()
    png = bytearray(media.encode_png(rows.tobytes()))
    assert (media.decode_png(bytes(png)) == rows).all()
    for damaged in (png[:-5], png[:60] + bytes([png[60] ^ 1]) + png[61:], b"GIF" + png[3:]):
        with pytest.raises(media.DamagedPng):
            media.decode_png(bytes(damaged))


def test_licence_rules(spark):
    mit = "\n".join(licences.SENTENCES[k] + "." for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liable"))
    rows = [(1, "Foo bar.\n" + mit), (2, mit.replace(" ", "\n ")), (3, "Intro\nReleased under the MIT License.\nMore. Licensed under CC BY-NC 4.0."), (4, licences.SENTENCES["bsd-grant"] + ": " + licences.SENTENCES["bsd-binary"] + ". " + licences.SENTENCES["bsd-source"]), (5, "no licence")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["licences"] == got[2]["licences"] == "MIT" and got[3]["licences"] == "MIT,CC-BY-NC-4.0"
    assert got[4]["licences"] == "" and got[4]["n_known"] == 3  # known sentences in no rule's order
    assert (got[5]["licences"], got[5]["primary"], got[5]["n_known"]) == ("", None, 0)


def _wrapped(text, before="", width=72):
    import textwrap

    return "\n".join(before + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width - len(before)), ""])


def test_licence_files_as_shipped(spark):
    """With a title, copyright lines, quotes and list marks, wrapped, and in comments; scattered sentences are no licence."""
    s = {k: v + "." for k, v in licences.SENTENCES.items()}
    owner = "Copyright (c) 2020 Jane Doe\n\n"
    bsd = f"{owner.rstrip()}\nAll rights reserved.\n\n{s['bsd-grant'][:-1]}:\n\n1. {s['bsd-source']}\n\n2. {s['bsd-binary']}\n\n"
    files = {
        "MIT": f"MIT License\n\n{owner}{s['mit-grant'].replace('(the Software)', '(the \"Software\")')[:-1]}:\n\n{s['mit-notice']}\n\n{s['mit-as-is']} {s['mit-liable']}",
        "BSD-2-Clause": bsd + s["bsd-as-is"].replace(" AS IS", ' "AS IS"'),
        "BSD-3-Clause": f"{bsd}3. {s['bsd-endorse']}\n\n{s['bsd-as-is']}",
        "Apache-2.0": 'Copyright 2020 Jane Doe\n\nLicensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by law',
        "ISC": owner + s["isc-grant"] + "\n\n" + s["isc-as-is"],
        "GPL-3.0-or-later": f"{s['gpl-redistribute-3']}\n\n{s['gpl-hope']} {s['gpl-details']}",
        "MPL-2.0": f"{s['mpl-subject']} {s['mpl-copy-s']}",
    }
    rows = [(f"{name} {i}", how(text)) for name, text in files.items() for i, how in enumerate([str, _wrapped, *[lambda t, b=b: _wrapped(t, b) for b in ("# ", " * ", "// ")]])]
    filler = " ".join(f"Nothing of the kind is here {i}." for i in range(25))
    rows += [("none 1", f"{s['bsd-grant']} {filler} {s['bsd-source']} {filler} {s['bsd-binary']}"), ("none 2", "All rights reserved."), ("MIT,Apache-2.0 1", "// SPDX-License-Identifier: MIT OR Apache-2.0")]
    for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        expected = r["doc_id"].rsplit(" ", 1)[0]
        assert r["licences"] == ("" if expected == "none" else expected), r["doc_id"]


def test_expected_counts_take_all_emissions_at_once_and_agree_with_every_path():
    """Emissions were gathered at each step, there and back."""
    from itertools import product

    from keystate.llm import hmm

    class Emit:
        def __init__(self, x):
            self.x, self.dtype, self.taken = x, x.dtype, 0

        def __len__(self):
            return len(self.x)

        def __getitem__(self, at):
            self.taken += 1
            return self.x[at]

    rng = np.random.default_rng(4)
    k, classes = 2, 3
    start, move, emit = rng.dirichlet([1] * k), rng.dirichlet([1] * k, k), rng.dirichlet([1] * classes, k).T
    ids, offsets, lo, hi = np.array([0, 2, 1, 1, 2, 0, 1, 2]), np.array([0, 3, 7, 8]), np.array([0, 1, 0]), np.array([2, 3, 1])
    starts, moves, emissions, log_p = np.zeros(k), np.zeros((k, k)), np.zeros((classes, k)), None
    for a, b, own, end in zip(offsets, offsets[1:], lo, hi, strict=False):
        x = ids[a:b]
        paths = {z: start[z[0]] * np.prod([move[i, j] for i, j in zip(z, z[1:], strict=False)]) * np.prod(emit[x, list(z)]) for z in product(range(k), repeat=len(x))}
        whole = sum(paths.values())
        for z, p in paths.items():
            starts[z[0]] += p / whole * (own == 0)
            for t in range(own, end):
                emissions[x[t], z[t]] += p / whole
                if t:
                    moves[z[t - 1], z[t]] += p / whole
    sent = Emit(emit)
    s, m, e, log_p = hmm.expected_counts(ids, offsets, hmm.Parameters(start, move, sent), (lo, hi))
    for found, expected in ((s, starts), (m, moves), (e, emissions)):
        np.testing.assert_allclose(found, expected, rtol=1e-12, atol=1e-15)
    assert sent.taken == 1
