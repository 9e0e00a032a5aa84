import re

import pytest
from rows import by_id, documents

from lectern.llm import licenses as L

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words(text)
    return sorted((i, label, n) for p, label in L.BASE.items() for n in [len(p.split())]
                  for i in range(len(w) - n + 1) if w[i:i + n] == p.split())


MIT, APACHE, GPL = (L.TEMPLATES[k][0] for k in ("mit", "apache-2", "gpl"))
TEXTS = [None, "", "...", "Under the MIT-License, under the mit license!", "CC BY NC cc by nc cc by", "Apache License, Version 2.0",
         "x " * 5000 + MIT.title() + " y" * 5000, "// " + GPL.replace(" ", "\n// "), "this license is a license of software permission free",
         "cc by nd", "under the mit licenKe", "under the mİt license", "É日本 under_the mit license", "mit license the under " * 50,
         " ".join(reversed(MIT.split())), MIT.replace("charge", "cost"), "Licensed " + APACHE, "under the mit license " * 300]
#: What the method finds beside the base phrases.
LABELS = {6: ["mit"], 7: ["gpl"], 16: ["apache-2"]}


def test_against_brute_force(spark):
    docs = documents(spark, TEXTS).repartition(4)
    got = by_id(L.scan(docs, "text", ["doc_id", "label"]).select("keep.*", "n_words", "base", "labels", "score").collect())
    for i, t in enumerate(TEXTS):
        (r,) = got[i]
        want = base(t)
        assert (r.n_words, [tuple(x) for x in r.base]) == (len(words(t)), want), i
        assert r.labels == sorted({x[1] for x in want} | set(LABELS.get(i, []))), i
        assert r.score == 1.0 if want else (0.5 <= r.score <= 1 if i in LABELS else r.score == 0.0)
        assert r.label == "own label"


def test_words_must_agree_by_position_and_the_phrase_must_stand(spark):
    moved = MIT.split()
    moved[6:6] = ["filler"] * 3                # after the key phrase's start
    texts = [MIT, " ".join(moved), MIT.replace("hereby", "now")]
    rows = by_id(L.scan(documents(spark, texts), "text", ["doc_id"]).select("keep.doc_id", "labels").collect())
    assert rows[0][0].labels == ["mit"] and rows[1][0].labels == [] and rows[2][0].labels == []


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["cc by nc", "cc by nc", None], ids=[1, 1, None])
    rows = L.scan(docs, "text", ["doc_id"]).collect()
    assert sorted(len(r.base) for r in rows) == [0, 1, 1]
    assert L.scan(docs.limit(0), "text", ["doc_id"]).collect() == []


@pytest.mark.parametrize("label", L.TEMPLATES)
def test_each_template_holds_its_phrase(label):
    text, phrase = L.TEMPLATES[label]
    assert phrase in text and len(set(text.split()) - L._FUNCTION_WORDS) >= L.AGREE


def test_texts_with_several_licences(spark):
    from itertools import combinations

    held = [c for n in (1, 2, 3, len(L.TEMPLATES)) for c in combinations(L.TEMPLATES, n)]
    texts = [" filler words between ".join(L.TEMPLATES[t][0] for t in c) for c in held]
    # One licence among the words of all the others.
    loose = " ".join(reversed(L.VOCABULARY))
    texts += [f"{loose} {L.TEMPLATES[t][0]} {loose}" for t in L.TEMPLATES]
    held += [(t,) for t in L.TEMPLATES]
    got = by_id(L.scan(documents(spark, texts).repartition(4), "text", ["doc_id"]).select("keep.doc_id", "labels", "score").collect())
    for i, labels in enumerate(held):
        assert (got[i][0].labels, got[i][0].score) == (sorted(labels), 1.0), labels


def test_the_share_counts_all_words_at_their_places(spark):
    """The rarest words of the template are gone from the place; the rest decides."""
    idf = {w: 1.0 for w in L.VOCABULARY}
    own = MIT.split()
    for kept in range(len(own) + 1):
        known = set(own[:kept]) & idf.keys()
        if len(known) >= L.LEAST_SHARE * len(set(own) & idf.keys()):
            assert known & L._rare("mit", idf)
    cut = [" ".join(own[:n]) for n in range(8, len(own) + 1)]
    got = by_id(L.scan(documents(spark, cut), "text", ["doc_id"]).select("keep.doc_id", "labels", "score").collect())
    scores = [got[i][0].score for i in range(len(cut))]
    assert scores[-1] == 1.0 and scores == sorted(scores)
