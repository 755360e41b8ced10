"""Encoding and decoding against the tokenizers library, and the dynamic programme against merging."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeweave.llm import bpe

from .helpers import docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tables():
    return bpe.read_tables(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    r = random.Random(3)
    out = ["", " \n\t", "it's we're THEY'LL 'sx''s I'd", "ΑΣ Σίσυφος İstanbul ﬁ é́ é ǅ", "1234 ½ ² x_y", "a\x00b\x85c　d\xa0e\x1cf",
           "<|endoftext|>x <|startoftext|><|endoftext|", "<|EndOfText|>", "汉字漢字かな ㍿", "👍🏽 ok \U000e0041 \U00010d50", "ᲉꟋ", "=" * 999, "́ abc"]
    out += ["".join(r.choice("abcdeinrst' ") for _ in range(80)) for _ in range(400)]
    out += ["".join(r.choice("aab") for _ in range(r.randint(1, 40))) for _ in range(200)]
    out += ["".join(chr(r.choice((r.randrange(32, 0x600), r.randrange(0x2000, 0x3100), r.randrange(0x10000, 0x1FFFF)))) for _ in range(30)) for _ in range(200)]
    return out


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_equals_library(tables, library):
    for t in texts():
        ids = tables.encode(t)
        assert (np.frombuffer(ids, "<u4").tolist(), bpe.decoded(ids, tables.names)) == expected(library, t), t


def test_every_prefix_has_the_last_token_of_its_own_encoding(tables):
    """Brute force: merge the lowest pair, leftmost first, for every prefix."""
    def merge(symbols):
        s = list(symbols)
        while True:
            found = [(tables.pairs[p], i) for i, p in enumerate(zip(s, s[1:])) if p in tables.pairs]
            if not found:
                return s
            t, i = min(found)
            s[i:i + 2] = [t]
    r = random.Random(5)
    for word in ["internationalization", "aaaaaaaaaaa", "thethethe", "banana"] + ["".join(r.choice("aeinrst") for _ in range(14)) for _ in range(60)]:
        piece = list(word.encode())
        piece[-1] += 256
        assert tables.last_tokens(piece) == [merge(piece[:i])[-1] for i in range(1, len(piece) + 1)]


def test_automaton_knows_exactly_the_substrings():
    sam, strings = bpe.SuffixAutomaton(), ["abcbc", "bcd", "aaaa", "cab"]
    for s in strings:
        sam.add(s)
    subs = {s[i:j] for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    r = random.Random(1)
    for w in subs | {"".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(300)}:
        try:
            sam.find(w)
            known = True
        except KeyError:
            known = False
        assert known == (w in subs)


def test_long_texts_are_cut_where_nothing_reaches_across(tables, library, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 16)
    for t in texts() + ["e ́ a'll 's " * 50, "word " * 200, "x" * 500]:
        assert np.frombuffer(tables.encode(t), "<u4").tolist() == expected(library, t)[0]


def test_small_memo(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    own = bpe.read_tables(PATH)
    for t in texts()[:60]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == expected(library, t)[0]


def test_query(spark, tables, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts()[:40])] + [(100, None), (None, "no id"), (101, "same"), (101, "same"), (102, "long text " * 30000)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, bpe.op13_bpe(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for d, t in rows:
        ids, text = expected(library, t)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_empty_table_and_unknown_ids(spark, tables):
    assert bpe.decode(bpe.encode(docs(spark, []), tables), tables).collect() == []
    assert bpe.decoded(np.array([518, 999999, 519], "<u4").tobytes(), tables.names) == "the</w> ing</w>"
