import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import by_id, documents

from lectern.llm import bpe
from lectern.llm import queries as Q

FILE = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.splitlines())}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Encoder(FILE, P.PATTERN)


def test_every_token_encodes_to_itself():
    bpe.Ranks(FILE, check=True)


def test_a_vocabulary_that_breaks_the_premise_is_refused():
    bad = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"abc": 4, b"bc": 5, b"abcabc": 6}
    file = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in bad.items() if t != b"abc")
    with pytest.raises(ValueError):
        bpe.Ranks(file, check=True)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abet hing \n\t'sAé日🙂1=-.　\x1c\u0085")), max_size=120))
def test_matches_the_library(text):
    ids = OURS.encode([text])[0]
    assert bpe.unpack(ids) == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 4000, "=" * 3000 + "x", "é" * 999, " " * 5000 + "x", "the quick " * 30000,
                                  "".join(random.Random(1).choices("abcdefgh", k=20000))])
def test_long_runs(text):
    ids = OURS.encode([text])[0]
    assert bpe.unpack(ids) == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.integers(0, 200))
def test_join_is_the_encoding_of_both_sides(data, at):
    r = OURS.ranks
    left, right = data[:at], data[at:]
    if left and right:
        assert r.join(r.merge(left), r.merge(right)) == r.merge(data)
    assert r.encode(data) == r.merge(data)
    assert bpe.unpack(r.leaves([data])[0]) == r.merge(data)


def test_query_over_awkward_rows(spark):
    texts = [None, "", "plain words, twice", "plain words, twice", "日本語 <|endoftext|> '\"", "x" * 5000 + " é" * 5000]
    docs = documents(spark, texts, ids=[1, 2, 3, 3, None, 6])
    got = by_id(Q.bpe_digests(docs).collect())
    for i, t in zip([1, 2, 3, 3, None, 6], texts):
        ids = THEIRS.encode_ordinary(t or "")
        for r in got[i]:
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert len(got[3]) == 2
    assert Q.bpe_digests(docs.limit(0)).collect() == []
