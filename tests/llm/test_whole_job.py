"""Cases in which a shorter way would do less than the whole job."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from keystate.llm import hmm, language_model, mixing, multiset, simhash

from .conftest import SCHEMA
from .test_pipeline import extra_copies


def _roots(nodes, pairs):
    parent = {int(f): int(f) for f in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        parent[max(a, b)] = min(a, b)
    return [find(int(f)) for f in nodes]


def _all_links(fps):
    """Every pair of different fingerprints within three bits, by flipping up to three of the bits that vary."""
    from itertools import combinations

    bits = [b for b in range(64) if len(np.unique(fps >> np.uint64(b) & np.uint64(1))) > 1]
    pairs = []
    for n in (1, 2, 3):
        for flips in combinations(bits, n):
            other = fps ^ np.uint64(sum(1 << b for b in flips))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = (fps[at] == other) & (other > fps)
            pairs += zip(fps[hit].tolist(), other[hit].tolist(), strict=True)
    return pairs


def test_long_lists_with_constant_bytes_lose_no_link():
    """A list over LONG whose fingerprints share five bytes, one of them outside any set of four that the list may have."""
    rng = np.random.default_rng(11)
    at = lambda b: np.uint64(8 * b)
    low = np.unique(rng.integers(0, 2**24, 23_000).astype(np.uint64))
    spread = (low & np.uint64(255)) << at(1) | (low >> np.uint64(8) & np.uint64(255)) << at(4) | (low >> np.uint64(16)) << at(6)
    fps = np.sort(np.uint64(0x7B0011009A22C35D) & ~(np.uint64(255) << at(1) | np.uint64(255) << at(4) | np.uint64(255) << at(6)) | spread)
    assert len(fps) > simhash.LONG
    found = [(a, b) for batch in simhash._links(np.array([len(fps)]), fps) for a, b in zip(*(batch.column(i).to_numpy().view(np.uint64).tolist() for i in range(2)), strict=True)]
    expected = _roots(fps, _all_links(fps))
    assert len(set(expected)) < len(fps) and _roots(fps, found) == expected


def _sentence_share(a, b):
    a, b = ({x for p in t.split("\n") for x in p.split(". ")} for t in (a, b))
    return len(a & b) / len(a | b)


def test_likeness_of_long_texts_follows_their_sentence_share(spark):
    texts = [". ".join(f"sentence {d} {i} of a long text" for i in range(n)) for d, n in enumerate((10_000, 100_000, 3_000, 12))]
    got = {r["doc_id"]: r for r in multiset.compare_edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        n, after = len(t), texts[(d + 1) % len(texts)]
        edit = t[: n - n // 4] + after[: n // 4]
        assert abs(got[d]["near_edited"] - _sentence_share(t, edit)) < 0.25
        assert got[d]["near_next"] < 0.1


def test_likeness_of_long_texts_of_few_lines(spark):
    lines = [f"line {i} of a page" for i in range(30)]
    texts = ["\n".join(lines * 100), "\n".join([*lines * 100, "one more"])]
    got = multiset.compare_edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("doc_id = 0").first()
    assert got["near_next"] > 0.8


@pytest.mark.parametrize(("sizes", "expected"), [([100] * 4, [2000 / 13, 800 / 13, 400 / 13, 2000 / 13]), ([50, 20, 10] * 2, [50, 20, 10] * 2)])
def test_targets_of_tied_sources(spark, sizes, expected):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
    assert sum(got) == pytest.approx(sum(sizes)) and got == pytest.approx(expected)


def test_unequal_inclusion_with_repeated_and_null_rows(spark):
    """Rows that repeat are ranked each by itself, in whatever tasks they are; longer documents are likelier to be in."""
    from collections import Counter

    rows = [(7, "w " * 20, "en", "a")] * 1000 + [(i, "w " * (i % 13), "en", "b") for i in range(500)] + [(None, "x y z", None, None)] * 40 + [(3, None, "en", "b")] * 3 + [(9000 + i, "q " * 5, "en", "c") for i in range(30)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    per = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert sum(t for t, _ in per.values()) == pytest.approx(sum(n for _, n in per.values()))
    expected = Counter()
    for s, (target, total) in per.items():
        own = [(d, len(t.split()) if t else 0) for d, t, _, source in rows if source == s]
        whole = int(target // total)
        expected.update((d, n, n * (whole + more)) for (d, n), more in zip(own, extra_copies(own, target - whole * total), strict=True))
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target) <= 20
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == expected
    in_more = lambda n: [r["copies"] for r in got if r["source"] == "b" and r["size"] == n]
    assert sum(in_more(12)) / len(in_more(12)) > sum(in_more(1)) / len(in_more(1))


def test_repeated_keeps_a_column_named_as_a_new_one(spark):
    df = spark.createDataFrame([(i, "a b c", "s", f"kept {i}") for i in range(6)], "doc_id long, text string, source string, size string")
    assert {r["size"] for r in mixing.repeated(df).collect()} == {f"kept {i}" for i in range(6)}


def test_dedup_keeps_different_texts_of_one_id(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog again", "s"), (1, "quite another text about rivers and mornings in a far town", "s"), (2, "the quick brown fox jumps over the lazy dog again", "t"), (None, "x", "s"), (None, "x", "s")]
    df = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, source string")
    found = [sorted(map(repr, simhash.deduplicated(df.repartition(n)).collect())) for n in (1, 3)]
    assert found[0] == found[1] == sorted(map(repr, spark.createDataFrame([rows[0], rows[1], rows[3], rows[4]], df.schema).collect()))


class _Sent:
    def __init__(self, value):
        self.value = value


def test_words_of_long_texts_are_cut_a_few_mb_at_once():
    """2,000 texts were cut at once, however long: 12 MB here. Nothing is lost of what they hold."""
    texts = [f"Word{i % 7} the common {i} " * 900 for i in range(600)] + ["", None]
    counted, total = language_model._tally([_rows(texts)]), {}
    for b in counted:
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
            total[w] = total.get(w, 0) + n
    plain = Counter(w for t in texts if t for w in t.lower().split())
    assert total == plain
    table = language_model.Table(pa.array(["the", "common", "word3"]), np.array([9, 8, 7]))
    got = list(language_model._coder(_Sent((table, 5)))([_rows(texts), _rows([]), _rows(["the end"])]))
    ids = [i for b in got for i in b.column("doc_id").to_pylist()]
    assert ids == [*range(602), 0]
    size = [len(t or "") for t in [*texts, "the end"]]
    for b, since in zip(got, np.cumsum([0, *(len(b) for b in got)]), strict=False):
        assert sum(size[since : since + len(b)]) <= 4 << 20
    at = {"the": 0, "common": 1, "word3": 2}
    for b in got:
        for i, codes, rare, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "codes", "rare", "n_tokens")), strict=True):
            words = (texts[i] or "").lower().split() if b is not got[-1] else ["the", "end"]
            coded = np.frombuffer(codes, "<i4")
            assert len(coded) == n == len(words) + 1 and coded[-1] == language_model.END_CLASS
            assert [c for c in coded[:-1].tolist() if c < language_model.FREQUENT] == [at[w] for w in words if w in at]
            assert rare == [w for w in words if w not in at]


def _rows(texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string()), pa.array([False] * n, pa.bool_())], ["doc_id", "text", "held_out"])


def test_a_long_text_is_learned_from_in_bounded_portions(monkeypatch):
    """All states of one text of 900,000 words were held at once. The counts are those of one call."""
    codes = np.random.default_rng(3).integers(0, language_model.CLASSES, 900_000).astype("<i4")
    texts = [codes[:300], codes, codes[:1]]
    p = hmm.seeded(np.full(language_model.CLASSES, 1 / language_model.CLASSES), language_model.STATES)
    sequences, offsets, own = language_model._parts(texts)
    s, m, e, _ = hmm.expected_counts(sequences, offsets, p, own)
    held, real = [], hmm.expected_counts
    monkeypatch.setattr(hmm, "expected_counts", lambda ids, *a: held.append(len(ids)) or real(ids, *a))
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], ["codes"])
    (found,) = language_model._expect(_Sent((p.start, p.move, p.emit)))([batch])
    assert max(held) <= 1.5 * language_model.TRAINED_AT_ONCE + 2 * language_model.WINDOW
    at, rows = found.column(0).to_numpy(), np.stack([found.column(f"s{j}").to_numpy() for j in range(language_model.STATES)], axis=1)
    np.testing.assert_allclose(rows[at >= 0], e[at[at >= 0]], rtol=1e-9)
    np.testing.assert_allclose(rows[(at < 0) & (at > -100)], m, rtol=1e-9)
    np.testing.assert_allclose(rows[at == -100][0], s, rtol=1e-9)
