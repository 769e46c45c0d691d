"""The pipeline, stage by stage on each stage's own input, against plain Python."""

import hashlib
import math
import re
from collections import Counter

import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from keystate.llm import common, language_id, tokens

from .conftest import SCHEMA


def simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def kept_by_dedup(rows):
    fps, group = {r["doc_id"]: simhash(r["text"] or "") for r in rows}, {}
    for d in sorted(fps):
        near = {group[o] for o in group if (fps[o] ^ fps[d]).bit_count() <= 3}
        root = min(near | {d})
        for o, g in list(group.items()):
            if g in near:
                group[o] = root
        group[d] = root
    return {d for d, g in group.items() if d == g}


def copies(rows):
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")) for r in rows}
    of, total = {}, Counter()
    for r in rows:
        of.setdefault(r["source"], []).append(r["doc_id"])
        total[r["source"]] += size[r["doc_id"]]
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = sum(total.values()), set(of), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * total[s]
            free.discard(s)
            left -= target[s]
    out = {}
    for s, docs in of.items():
        f = target[s] / total[s] if total[s] else 0
        rest = target[s] - math.floor(f) * total[s]
        for d, more in zip(docs, extra_copies([(d, size[d]) for d in docs], rest), strict=True):
            out[d] = math.floor(f) + more
    return out


def extra_copies(rows, rest):
    """Which of a source's rows (id, words) get one more copy: 1 or 0 for each, in their order."""
    if rest <= 0:
        return [0] * len(rows)
    level = None
    for n in sorted({n for _, n in rows if n}, reverse=True):
        squares, larger = sum(m * m for _, m in rows if m <= n), sum(m for _, m in rows if m > n)
        if squares >= n * (rest - larger):
            level = squares / (rest - larger)
            break

    def rank(i):
        d, n = rows[i]
        x = int(hashlib.sha256(f"mix:{'' if d is None else d}".encode()).hexdigest()[:12], 16)
        u, p = (x + 0.5) / 2**48, n / level
        return (0.0 if p >= 1 else (u / (1 - u)) * ((1 - p) / p), x, str(d), n)

    out, under = [0] * len(rows), 0
    for i in sorted((i for i in range(len(rows)) if rows[i][1]), key=rank):
        out[i] = int(2 * under + rows[i][1] <= 2 * rest)
        under += rows[i][1]
    return out


def test_stages_against_plain_python(spark, prose, tmp_path):
    copies_of = [(300 + i, prose[i][1], prose[i][2], "s0") for i in range(0, 60, 3)]
    junk = [(400, None, "en", "s0"), (401, "", None, "s1"), (402, "123 !!! 456", "en", "s1"), (403, "... ...", None, None)]
    spark.createDataFrame([*prose, *copies_of, *junk], SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{i}"))
        docs, after = spark.read.parquet(str(tmp_path / f"{i}")), None
        after = docs.collect()
        seen.append(name)
        if name == "language_id":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {400, 401, 402, 403}
        elif name == "simhash_near_dedup":
            assert sorted(r["doc_id"] for r in after) == sorted(kept_by_dedup(before))
        elif name == "source_mixing":
            assert Counter(r["doc_id"] for r in after) == +Counter(copies(before))
        else:
            library = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
            n = Counter()
            for r in before:
                n[r["doc_id"]] += len(library.encode(r["text"], add_special_tokens=False).ids) + 1
            got, bins = Counter(), {}
            for r in after:
                got[r["doc_id"]] += r["length"]
                bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert got == n
            for parts in bins.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= 2048
            assert len(bins) <= -(-sum(n.values()) // 2048) + 1
        if i < 3:
            assert docs.columns == ["doc_id", "text", "lang", "source"]
    assert seen == ["language_id", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, after))


def test_memory_that_is_free_goes_back_before_a_stage_and_landmarks_after_training(spark, prose, monkeypatch):
    """Else the driver keeps what its allocators and earlier stages held, run after run."""
    docs, calls, sent = spark.createDataFrame(prose[:40], SCHEMA), [], []
    give_back, broadcast = common.give_back, spark.sparkContext.broadcast
    monkeypatch.setattr(common, "give_back", lambda *a, **b: calls.append(give_back(*a, **b)))
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(broadcast(value)) or sent[-1])
    assert give_back(spark) and not give_back(spark, every=60)
    for _, stage in corpus_pipeline.STAGES[1:3]:
        n = len(calls)
        stage(spark, docs, "")
        assert calls[n]
    language_id.train(docs)
    assert len(sent) == 1 and not sent[0]._jbroadcast.isValid()
