"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

A text is normalised (NFC, lower case), cut into pieces by the tokenizer's pattern, and each
piece is a string of byte symbols whose last one carries the end-of-word mark. The encoding of a
piece is found without replaying merges: every prefix of it has one encoding, hence one
*last token*, which is the token ending there that is compatible with the last token of
the prefix before it.

* Matches. A suffix automaton of all tokens (``SuffixAutomaton``) reads the piece once; its state
  after a prefix gives, along the suffix links, the tokens that end there, longest first.
* Pair test. Two tokens may stand side by side if undoing their merges, latest first, never meets
  a merge across the border that would have come earlier (``compatible``).
* Following the stored last tokens back from the end gives the ids.

Tokens that their own merges would not produce alone never occur and are left out of the matches.
The tables (bounded by the vocabulary file) are made once by the driver and broadcast; pieces
are remembered in a bounded table per worker, so a frequent word is encoded once. Documents are
encoded row by row: no shuffle, and a hot source or a lost executor changes nothing.

Defined cases: null text is empty text (no ids, empty decoded text); the strings of added tokens,
as ``<|endoftext|>``, are their ids wherever they stand; long texts are cut before blanks,
where no piece and no normalisation reaches across; a null id and repeated rows pass through; ids that the vocabulary does not hold are
skipped when decoding; an empty table gives an empty result; other columns are ignored."""
from __future__ import annotations

import json
import unicodedata
from struct import pack, unpack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, own_columns, share

#: Pieces remembered per worker, their longest length, and characters of a text worked on at once.
MEMO, MEMO_CHARS, PART = 1 << 17, 64, 1 << 20
#: Rows per batch of results.
ROWS = 256

#: Characters whose tables no recent Unicode version changed; texts with others are normalised and
#: cut by the tokenizer's own library, so that both follow one version.
SETTLED = "\x00-᱿Ḁ-㏿㐀-鿿가-힣豈-￿\U0001f300-\U0001faff"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable, others from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(more))
        more += b not in plain
    return out


class SuffixAutomaton:
    """Smallest automaton of all substrings of the added strings, by online extension.
    A state stands for strings that end at the same places; its link is the longest suffix
    that ends at more."""

    def __init__(self):
        self.step, self.link, self.longest = [{}], [-1], [0]

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.longest.append(self.longest[p] + 1)
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, string) -> int:
        """Adds a string of symbols; returns the state it ends in (until later additions split it)."""
        last = 0
        for c in string:
            p, q = last, self.step[last].get(c)
            if q is not None:
                last = q if self.longest[q] == self.longest[p] + 1 else self._split(p, c, q)
                continue
            last = len(self.step)
            self.step.append({})
            self.link.append(0)
            self.longest.append(self.longest[p] + 1)
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = last
                p = self.link[p]
            if p >= 0:
                q = self.step[p][c]
                self.link[last] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, c, q)
        return last

    def find(self, string) -> int:
        at = 0
        for c in string:
            at = self.step[at][c]
        return at


class Memo(dict):
    """Results of a function for recent short arguments: a bounded number, the older half of them in ``old``."""

    def __init__(self, function):
        super().__init__()
        self.function, self.old = function, {}

    def __missing__(self, piece):
        got = self.old.get(piece)
        if got is None:
            got = self.function(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class Bpe:
    """Tables of one tokenizer file. Symbols and merged tokens are numbered in order of their merges;
    ``ids`` translates the numbers to the ids of the file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE tokenizer")
        self.spec, self.end = text, model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab, chars = model["vocab"], byte_chars()
        marks = ["", self.end] if self.end else [""]
        names = [c + m for m in marks for c in chars]
        self.symbols = len(names)
        strings = [(i,) for i in range(self.symbols)]
        number = {n: i for i, n in enumerate(names)}
        self.left, self.right, self.pairs = list(range(len(names))), list(range(len(names))), {}
        for m in model["merges"]:
            a, b = (number[x] for x in (m.split(" ") if isinstance(m, str) else m))
            name = names[a] + names[b]
            if name in number:
                raise ValueError(f"two merges make {name!r}")
            number[name] = len(names)
            self.pairs[a, b] = len(names)
            names.append(name)
            strings.append(strings[a] + strings[b])
            self.left.append(a)
            self.right.append(b)
        self.ids = [vocab[n] for n in names]
        self.names = {i: n for n, i in vocab.items()} | {i: n for n, i in self.added.items()}
        self.sizes = [len(s) for s in strings]
        self._match(strings)
        self.tested: dict = {}
        self.memo = self.cutter = None  # made where they are used

    def _match(self, strings) -> None:
        alone = [True] * self.symbols
        for t in range(self.symbols, len(strings)):
            a, b = self.left[t], self.right[t]
            alone.append(alone[a] and alone[b] and self.compatible(a, b, t))
        sam = SuffixAutomaton()
        for s in strings:
            sam.add(s)
        own: dict = {}
        for t, s in enumerate(strings):
            if alone[t]:
                own.setdefault(sam.find(s), []).append(t)
        self.link, self.longest = sam.link, sam.longest
        # one table of steps for all states, and each state's tokens with those of its suffixes
        self.step = {state * self.symbols + c: to for state, steps in enumerate(sam.step) for c, to in steps.items()}
        self.ending: list = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.longest.__getitem__):
            mine = tuple(sorted(((t, self.sizes[t]) for t in own.get(state, ())), key=lambda x: -x[1]))
            self.ending[state] = mine + self.ending[self.link[state]] if mine else self.ending[self.link[state]]

    def compatible(self, a: int, b: int, before: int = 1 << 62) -> bool:
        """Whether tokens a and b stay apart side by side: undoes their merges, latest first; no merge
        across the border may have come before the one undone last (at equal merges the left one comes first)."""
        pairs, left, right = self.pairs, self.left, self.right
        while True:
            if pairs.get((a, b), before) < before:
                return False
            if a > b:
                before, a = a, right[a]
                if a == before:
                    before, b = b + 1, left[b]
                    if b + 1 == before:
                        return True
            else:
                before, b = b + 1, left[b]
                if b + 1 == before:
                    before, a = a, right[a]
                    if a == before:
                        return True

    def last_tokens(self, piece) -> list[int]:
        """The last token of the encoding of every prefix of a piece of symbols."""
        step, link, longest, ending, tested, n = self.step, self.link, self.longest, self.ending, self.tested, self.symbols
        last, state, have, i = [], 0, 0, 0
        for c in piece:
            i += 1
            key = state * n + c
            while key not in step:
                state = link[state]
                have = longest[state]
                key = state * n + c
            state = step[key]
            have += 1
            for t, size in ending[state]:
                if size > have:
                    continue
                if size == i:
                    break
                pair = last[i - size - 1], t
                if pair not in tested:
                    if len(tested) > 4 * MEMO:
                        tested.clear()
                    tested[pair] = self.compatible(*pair)
                if tested[pair]:
                    break
            last.append(t)
        return last

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        s = list(piece.encode())
        if self.end:
            s[-1] += 256
        last, at, out = self.last_tokens(s), len(s), []
        while at:
            t = last[at - 1]
            out.append(self.ids[t])
            at -= self.sizes[t]
        return pack(f"<{len(out)}I", *reversed(out))

    def pieces(self, text: str) -> list[str]:
        """Normalised pieces of a text without added tokens."""
        import re

        import regex
        if self.cutter is None:
            from tokenizers import Tokenizer
            spec = json.loads(self.spec)
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            library = Tokenizer.from_str(self.spec)
            self.cutter = regex.compile(pattern), re.compile(f"[^{SETTLED}]"), library
        cut, odd, library = self.cutter
        if odd.search(text):
            back = {c: b for b, c in enumerate(byte_chars())}
            found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
            return [bytes(back[c] for c in w).decode() for w, _ in found]
        return cut.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _parts(self, text: str):
        """The text cut into (string, id of an added token or None), long strings before a blank."""
        import re
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", text) if self.added else [text]
        for part in parts:
            at = 0
            if part in self.added:
                yield part, self.added[part]
                continue
            while len(part) - at > PART:
                cut = part.find(" ", at + PART)
                if cut < 0:
                    break
                yield part[at:cut], None
                at = cut
            yield part[at:], None

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self.memo is None:
            self.memo = Memo(self.encode_piece)
        piece_ids = self.memo.__getitem__
        return b"".join([pack("<I", added) if added is not None else b"".join(map(piece_ids, self.pieces(part)))
                         for part, added in self._parts(text)])


def decoded(ids: bytes, names: dict) -> str:
    """The tokens' names with blanks between, as a tokenizer file without a decoder has it."""
    return " ".join(filter(None, map(names.get, unpack(f"<{len(ids) // 4}I", ids))))


def read_tables(path: str) -> Bpe:
    """Tables of a tokenizer file of the driver (``path`` is a parameter; executors need no file)."""
    with open(path, encoding="utf-8") as f:
        return Bpe(f.read())


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode(docs: DataFrame, tables: Bpe) -> DataFrame:
    """(doc_id, ids): the whole text's token ids, as little-endian 32-bit integers in a binary."""
    held = share(docs.sparkSession, tables)

    def run(batches):
        import pyarrow as pa
        bpe = held.value
        for b in _slices(batches):
            ids = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
    d = own_columns(docs, doc_id=("doc_id", "long"), text=("text", "string"))
    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tables: Bpe) -> DataFrame:
    """Adds ``text``, decoded from ``ids`` of (doc_id, ids)."""
    held = share(encoded.sparkSession, tables.names)

    def run(batches):
        import pyarrow as pa
        names = held.value
        for b in _slices(batches):
            texts = [decoded(x or b"", names) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op13_bpe(spark, sf_dir):
    import public_tokenizers
    tables = read_tables(public_tokenizers.path("word_bpe_49k.json"))
    d = decode(encode(load(spark, sf_dir, "documents"), tables), tables)
    return d.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op13_bpe": op13_bpe}
ORACLES = {}
