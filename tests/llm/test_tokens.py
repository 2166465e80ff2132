import base64
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
from millrace.llm.tokens import PATTERN, TOKENIZER_DIR, EncodedText, Prefixes, encoder, token_counts, token_ids  # noqa: E402

PATH = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
BITS = ["a", "b", " ", "\n", "\r", "\t", "1", "é", "²", "\x1c", "\x85", "\xa0", "　", "'s", "<|endoftext|>", "漢", "-", "__", "the", " the", "ing", "😀", "​"]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_against_the_library(reference):
    r, e = random.Random(4), encoder(PATH)
    for _ in range(4000):
        s = "".join(r.choice(BITS) for _ in range(r.randrange(16)))
        assert e.encode(s) == reference(s), repr(s)
    long = "".join(r.choice("abcdefgh") for _ in range(30_000))
    assert e.encode(long) == reference(long)
    assert e.encode(None) == e.encode("") == []


def test_prefix_tables_grow_and_are_cut(reference):
    v = encoder(PATH).vocabulary
    p = Prefixes(v, b"incompre")
    p.extend(b"hensibility")
    assert p.ids() == v.merged(b"incomprehensibility")
    p.cut(5)
    assert p.ids() == v.merged(b"incom")
    for i in range(1, 12):
        assert Prefixes(v, b"hypothesise"[:i]).ids() == v.merged(b"hypothesise"[:i])


def test_appends_and_edits(reference):
    r, e = random.Random(9), encoder(PATH)
    for _ in range(400):
        s = "".join(r.choice(BITS) for _ in range(r.randrange(20)))
        d = EncodedText(e, s)
        for _ in range(5):
            i = r.randrange(len(s) + 1)
            j = r.randrange(i, len(s) + 1) if r.random() < 0.6 else len(s)
            i = len(s) if r.random() < 0.4 else i
            j = max(i, j)
            new = "".join(r.choice(BITS) for _ in range(r.randrange(5)))
            s = s[:i] + new + s[j:]
            d.replace(i, j, new)
            assert d.text == s and d.ids() == reference(s)
        d.append("more text")
        assert d.ids() == reference(s + "more text")


def test_query_over_rows(spark, reference):
    rows = [(1, "Hello world\n\n2\n", "x"), (2, "", None), (3, None, "y"), (1, "Hello world\n\n2\n", "x"), (4, "<|endoftext|>", ""), (5, "z" * 100_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in token_ids(df, "doc_id", "text").collect())
    assert got == sorted((i, reference(t) if t else []) for i, t, _ in rows)
    assert sorted(r["n_tokens"] for r in token_counts(df, ["doc_id", "ids"], "text").collect()) == sorted(len(reference(t)) if t else 0 for _, t, _ in rows)
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0
