"""Token ids of whole texts by way of their pieces.

Each library cuts a text into pieces before it merges within them. The cuts used here
are places where none of the three can merge across (each class says why), so the ids
of a text are those of its pieces, which repeat. A worker keeps the pieces it has met
in a bounded cache; the library itself gives the ids of the others.

The vocabulary file is a parameter: a path, or a name that the installed vocabulary
package knows.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker's cache holds at most: some 200 bytes each. Texts of other pieces cost more time, nothing else.
CACHE = 900_000
#: Pieces of at most so many characters are kept.
LONGEST = 48
#: Texts whose pieces are looked up together, and bytes of texts that are cut at once by columns.
GROUP, AT_ONCE = 200, 16 << 20


def _bytes_as_characters() -> dict[int, int]:
    """Byte-level vocabularies write a byte that prints as itself, and the others from 256 on in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(sorted({*range(256)}.difference(prints)))}


BYTES = _bytes_as_characters()


def vocabulary(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A cache of pieces, each with its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, most: int = CACHE):
        self.known: dict[str, bytes] = {"": b""}
        self.most = most
        self.load(vocabulary(name))

    def load(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Of pieces by the library; of a plain run by the library's merges alone, as no other step changes it."""
        run, merge = self.run.fullmatch, self.tokenizer.model.tokenize
        runs = {p: array("I", [t.id for t in merge(p if p.isascii() and p[:1] != " " else p.encode().decode("latin-1").translate(BYTES))]).tobytes() for p in pieces if run(p)}
        if len(runs) < len(pieces):
            others = [p for p in pieces if p not in runs]
            runs.update(zip(others, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(others, add_special_tokens=False)), strict=True))
        return [runs[p] for p in pieces]

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def parts(self, piece: str) -> list[str] | None:
        """Smaller pieces of one that is not known, or None."""
        return None

    def add(self, pieces: set[str]) -> list[str]:
        """Make pieces known; returns those to be forgotten after use, as the cache is full."""
        run = self.run.fullmatch
        split = {p: q for p in pieces if not run(p) and (q := self.parts(p))}
        rest = [p for p in pieces if p not in split]
        rest += {q for parts in split.values() for q in parts}.difference(self.known, rest)
        room, known = self.most - len(self.known), self.known
        known.update(zip(rest, self.encode(rest), strict=True))
        for p, parts in split.items():
            known[p] = b"".join([known[q] for q in parts])
        new = [*rest, *split]
        return [p for i, p in enumerate(new) if i >= room or len(p) > LONGEST]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        cuts = [self.cut(t) for t in texts]
        spare = self.add(missing) if (missing := set().union(*cuts).difference(self.known)) else []
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) for c in cuts]
        for p in spare:
            del self.known[p]
        return out


    def gathered(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of pieces one after the other, and how many each list has: each different piece is looked up once."""
        words = lists.flatten().dictionary_encode()
        each = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        coded, spare = list(map(self.known.get, each)), []
        if missing := [i for i, c in enumerate(coded) if c is None]:
            spare = self.add({each[i] for i in missing})
            for i in missing:
                coded[i] = self.known[each[i]]
        for w in spare:
            del self.known[w]
        taken = pa.array(coded, pa.large_binary()).take(words.indices)
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int64, len(taken) + 1) // 4
        ids = np.frombuffer(data, "<u4", int(ends[-1])) if data else np.zeros(0, "<u4")
        return ids, np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


def portions(batch: pa.RecordBatch, text: str = "text", most: int = AT_ONCE):
    """The batch in slices of about so many bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


class WordPieces(Pieces):
    """For the word-end vocabulary. It makes each white space one blank and drops it, and
    neither its merges nor composition of characters cross it, so blanks and line ends
    cut. Of plain pieces, its pattern also cuts letters from digits and from marks;
    digits stand alone. Quotes (its 's, 're and the like) and special strings are left
    to the library, as is everything outside Latin-1's letters and ASCII."""

    plain = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
    runs = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ]+")
    run = re.compile(r"[a-zß-öø-ÿ]+")

    #: A mark behind a plain letter starts a run of marks, so a blank before it changes nothing.
    #: Those that special strings are made of stay, as do quotes.
    marks = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!#$%&()*+,\-./:;=?@\[\\\]^_`{}~])"

    def cut(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has: ``ids`` by columns.

        Capitals A to Z may be made small first, as composition and lower case go together;
        only a special string must not come about that way.
        """
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, self.marks, r"\1 \2"))
        return self.gathered(lists)

    def parts(self, piece: str) -> list[str] | None:
        if not self.plain.fullmatch(piece) or "<|" in piece:
            return None
        found = self.runs.findall(piece.lower())
        return found if found != [piece] else None


class BytePieces(Pieces):
    """For the byte-level vocabulary. Its pattern takes a blank with the word after it
    and never looks back, so a blank between two characters that are not white space
    starts a piece, and so does a lone line end between such; what follows that is a
    piece of its own. Of plain pieces, letters, digits and marks are cut apart, each
    with the blank before it. Quotes and special strings are left to the library."""

    other = re.compile(r"[^\S \n]")
    cuts = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
    plain = re.compile(r" ?[!-&(-~À-ÖØ-öø-ÿ]+")
    run = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
    runs = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ A-Za-z0-9À-ÖØ-öø-ÿ]+")

    def cut(self, text: str) -> list[str]:
        found = []
        for line in text.split("\n"):
            first, *words = line.split(" ")
            if not first or "" in words:  # blanks or line ends that meet
                return self.cuts.split(text)
            found.append(first)
            found += [" " + w for w in words]
            found.append("\n")
        found.pop()
        return found if not self.other.search(text) else self.cuts.split(text)

    #: Texts that are not cut at each blank and around each line end: where these meet, or there is other white space.
    hard = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]"

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has: ``ids`` by columns."""
        texts = pc.fill_null(texts, "")
        hard = pc.match_substring_regex(texts, self.hard)
        some = pc.any(hard).as_py()
        easy = texts.filter(pc.invert(hard)) if some else texts
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(easy, " ", "\x01 "), "\n", "\x01\n\x01"), "\x01")
        if some:  # both kinds again in the order of the texts
            cut = pa.array([self.cut(t) for t in texts.filter(hard).to_pylist()], lists.type)
            h = hard.to_numpy(zero_copy_only=False)
            lists = pa.concat_arrays([lists, cut]).take(pa.array(np.where(h, len(easy) + np.cumsum(h) - 1, np.cumsum(~h) - 1)))
        return self.gathered(lists)

    def parts(self, piece: str) -> list[str] | None:
        if not self.plain.fullmatch(piece) or "<|" in piece:
            return None
        found = self.runs.findall(piece)
        return found if found != [piece] else None


_workers: dict[tuple, Pieces] = {}


def pieces(kind: type[Pieces], name: str, most: int = CACHE) -> Pieces:
    """One for each worker process, vocabulary and bound; later tasks of the worker find it warm."""
    if (kind.__name__, name, most) not in _workers:
        _workers[kind.__name__, name, most] = kind(name, most)
    return _workers[kind.__name__, name, most]
