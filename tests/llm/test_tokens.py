"""Pieces against the libraries, over strings of all kinds of white space, marks, special strings and characters."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from keystate.llm import range_coder, token_counts, tokens

ALPHABET = list("abcXYZ019 \n\t.,'!-") + ["  ", "\n\n", " \n", "é", "ß", "日本", " ", " ", "​", "́", "<|endoftext|>", "\x00", "\x01", "\x85", "½", "²", "▁", "'s", ' "', "﻿", "　", "\U0001f600"]


def strings(n):
    rnd = random.Random(2)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40))) for _ in range(n)] + ["", None, " ", "\n", " a", "a ", "a\nb c"]


@pytest.mark.parametrize(("kind", "name"), [(tokens.BytePieces, "byte_bpe_50k.json"), (tokens.WordPieces, "word_bpe_49k.json")])
def test_ids_by_columns(kind, name):
    texts = strings(4000)
    library = Tokenizer.from_file(tokens.vocabulary(name))
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (tokens.CACHE, 50):  # a cache that is full from the start as well
        ids, n = kind(name, most).column(pa.array(texts, pa.string()))
        assert n.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]
    assert [np.frombuffer(x, "<u4").tolist() for x in kind(name).ids([t or "" for t in texts])] == expected


def test_counts_of_pieces():
    texts = [t or "" for t in strings(4000)]
    library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    assert token_counts.CountPieces("piece_bpe_32k.model").counts(texts) == [len(library.encode(t)) for t in texts]


def test_ids_are_cut_in_small_portions_and_memory_is_given_back(monkeypatch):
    """A worker of op2 holds some fifteen times the text that it cuts at once."""
    from keystate.llm import token_output

    seen, given = [], []
    column = tokens.WordPieces.column
    monkeypatch.setattr(tokens.WordPieces, "column", lambda self, texts: seen.append(texts.nbytes) or column(self, texts))
    monkeypatch.setattr(token_output, "TaskContext", type("T", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)}))
    pool = type("Pool", (), {"release_unused": lambda self: given.append(1)})()
    monkeypatch.setattr(token_output.pa, "default_memory_pool", lambda: pool)
    texts = [f"word{i % 97} and a line of others " * 20_000 for i in range(24)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(24), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    blocks = [range_coder.decode_block(b.column("data")[0].as_py()) for b in token_output._encode("word_bpe_49k.json", 1, 1 << 20)([batch])]
    assert max(seen) <= 2 * token_output.PORTION and given
    own = {}
    for ids, lengths, all_ids in blocks:
        own |= dict(zip(ids, np.split(all_ids, np.cumsum(lengths)[:-1]), strict=True))
    library = tokens.pieces(tokens.WordPieces, "word_bpe_49k.json").tokenizer
    assert sorted(own) == list(range(24))
    for i in (0, 23):
        assert own[i].tolist() == [*library.encode(texts[i], add_special_tokens=False).ids, 1]


def test_marks_behind_letters_are_cut_off_by_columns():
    """A word is kept once, whatever marks follow it; the ids stay those of the library, next to special strings and quotes as well."""
    marks, rnd = [chr(c) for c in range(33, 127) if not chr(c).isalnum()], random.Random(3)
    parts = [*marks, *marks, *"aZé0", "É", "Σ", "̸", "́", " ", "'s", "'LL", "<|", "|>", "endoftext", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    texts += [f"{a}{m}{b}" for m in marks for a in "aé0" for b in ("", "b", "̸", m, "'s")]
    library = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    for some in (texts, [t for t in texts if "<|" not in t]):
        expected = [library.encode(t, add_special_tokens=False).ids for t in some]
        ids, n = tokens.WordPieces("word_bpe_49k.json").column(pa.array(some, pa.string()))
        assert n.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]
    cache = tokens.WordPieces("word_bpe_49k.json")
    cache.column(pa.array([f"river{m * k}" for m in "#$%&*-/=" for k in (1, 3)]))
    assert [w for w in cache.known if "river" in w] == ["river"]


def test_the_decoder_searches_few_lanes(monkeypatch):
    """Order 0 is read from a guide; only lanes between its marks search, and find the same."""
    rnd = np.random.default_rng(4)
    ids = np.where(rnd.random(400_000) < 0.5, rnd.integers(0, 300, 400_000), rnd.integers(0, 49_000, 400_000) ** 2 // 49_000)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(range_coder.np, "searchsorted", lambda a, v, side: searched.append(len(v)) or search(a, v, side))
    for coded in (ids % 2000 * 20, ids[:100] % 3, np.zeros(9, int)):
        assert range_coder.decode_block(range_coder.encode_block([7], [len(coded)], coded))[2].tolist() == coded.tolist()
    assert sum(searched) < 0.2 * len(ids)
    for alphabet in (1, 2, 255, 49_384, range_coder.TOTAL // range_coder.FLOOR // 2):
        mixer = range_coder._Mixer(alphabet, 1)
        mixer.seen += rnd.integers(0, 9, alphabet) ** 6 * (rnd.random(alphabet) < 0.1)
        mixer.total = int(mixer.seen.sum())
        mixer.rebuild()
        at = np.concatenate([mixer.cum[:-1], mixer.cum[1:] - 1, rnd.integers(0, range_coder.TOTAL, 9999)])
        assert (mixer.order0(at) == search(mixer.cum, at, "right") - 1).all()


def test_ids_are_gathered_without_numbers_of_each_id():
    """Arrow copies the ids of each word; a portion is a whole batch of usual size, so its words are looked up once."""
    from keystate.llm import common, token_output

    cache = tokens.WordPieces("word_bpe_49k.json")
    texts = pa.array([" ".join(["qzxkvjwqbfhgzzkxqjv" * 2, "xxkqzvvjwpqfgbhhzqjk" * 2] * 4000), "", None, "a"] * 4)
    cache.column(texts)
    tracemalloc.start()
    ids, n = cache.column(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * len(ids) and n.sum() == len(ids) > 500_000
    own = np.frombuffer(cache.ids([texts[0].as_py()])[0], "<u4")
    assert n.tolist() == [len(own), 0, 0, 1] * 4 and (ids[: len(own)] == own).all()
    for empty in (["", None], []):  # no word at all, and words only before the slice
        ids, n = cache.column(pa.array(["before", *empty]).slice(1))
        assert ids.tolist() == [] and n.tolist() == [0] * len(empty)
    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 200_000] * 8)], names=["text"])
    assert batch.nbytes < common.BATCH_BYTES and len(list(tokens.portions(batch, most=token_output.PORTION))) == 1
